import struct

import zstandard

from quarry.llm.files import open_input
from quarry.llm.warc import DICTIONARY_MAGIC, ORACLE, digest, new_folder, op2_warc, read_archives, write_archives
from tests.llm.oracle import same


def test_sql(spark):
    assert same(spark, op2_warc, ORACLE) == 250


def test_round_trip(spark):
    long = "<p>é" + "x" * 300_000
    rows = [(i, f"http://h/{i % 7}\n", f"<html>{i % 40} common words here</html>" * (i % 9), i) for i in range(200)]
    rows += [(900, None, None, 1), (901, "u", "", 1), (902, "u", long, 1), (903, "u", long, 1), (None, "u", long, 1), (903, "u", long, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    folder = new_folder(spark, "warc")
    manifest = write_archives(pages.coalesce(1), folder, archive_bytes=50_000)
    got = read_archives(manifest, folder, with_payload=True).collect()
    assert len(got) == len(rows) and manifest.count() > 1
    largest = {}
    for page_id, _, html, _ in rows:
        if page_id is not None:
            largest[html or ""] = max(largest.get(html or "", -1), page_id)
    want = {(p, (h or "")): largest[h or ""] for p, _, h, _ in rows if p is not None}
    payload = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    for r in got:
        if r.page_id is None:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, long.encode())
            continue
        (keep,) = {k for (p, h), k in want.items() if p == r.page_id}
        assert (r.record_type, r.refers_to) == (("response", None) if keep == r.page_id else ("revisit", keep))
        assert r.payload_digest == digest(payload[keep]) and r.payload_bytes == len(payload[keep])
    name = manifest.orderBy("file").first().file
    raw = open_input(folder, name).read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == DICTIONARY_MAGIC
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(raw[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n") and first.count(b"WARC/1.1") == 1
    assert read_archives(write_archives(pages.limit(0), folder), folder).count() == 0


def test_few_records_have_a_dictionary_too(spark):
    for n in (1, 2, 7):
        rows = [(i, f"http://h/{i}", "<html>page %d</html>" % i) for i in range(n)]
        folder = new_folder(spark, "warc")
        manifest = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
        assert sorted((r.page_id, bytes(r.payload).decode()) for r in read_archives(manifest, folder, with_payload=True).collect()) == [(i, h) for i, _, h in rows]
        raw = open_input(folder, manifest.first().file).read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == DICTIONARY_MAGIC and size >= 100
        first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(raw[8 + size :])
        assert first.startswith(b"WARC/1.1\r\n")
