"""Operator 2: WARC archives compressed record by record under a Zstandard dictionary of their own.

An archive (``.warc.zst``) starts with a skippable frame that holds its dictionary; each record after it is
one frame, so any standard reader of concatenated frames that loads the dictionary can read it. The
dictionary is trained on ``sample_bytes`` of the archive's own records, in pieces spread evenly over it and over
long records (a bound on what is learned from, not on what is written). Where there is too little to train on, as in an
archive of one record, the pieces themselves are the dictionary (raw content): every archive has one.

Each page is a response record, or, where a page of larger id has the same payload of at least
``least_bytes``, a revisit that refers to the largest such id. Null html is an empty payload. Rows
of one page_id and payload are all responses if no larger id has it. A null page_id is always a response
that nothing refers to. Null urls are written as empty. No rows: no archives. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.files import AtomicFile, new_folder, open_input
from quarry.session import durable

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:quarry:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header (so the payload's length) without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    block = http + (payload if refers_to is None else b"")
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _pieces(records: list[bytes], most: int, piece: int = 16 << 10) -> list[bytes]:
    """About ``most`` bytes of records: the whole of short ones, pieces spread over long ones; of many, some spread evenly."""
    every = max(1, -(-sum(map(len, records)) // most))
    cut = [r[a : a + piece] for r in records for a in range(0, len(r), piece)]
    return cut[::every]


def write_archive(folder: str, name: str, records: list[bytes], level: int, dictionary_bytes: int, sample_bytes: int) -> None:
    import zstandard

    pieces = _pieces(records, sample_bytes)
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, pieces, k=256, d=8)
    except zstandard.ZstdError:  # too little to train on
        raw = b"".join(pieces)[:dictionary_bytes]
        trained = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = trained.as_bytes()
    out = AtomicFile(folder, name)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    zstd = zstandard.ZstdCompressor(level=level, dict_data=trained)
    for r in records:
        out.write(zstd.compress(r))
    out.close()


def read_archive(source) -> Iterator[dict]:
    """The records of an open archive in order: WARC header fields, ``length`` and ``payload``."""
    import zstandard

    head, trained = source.read(8), None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        trained = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", head)[1]))
    else:
        source.seek(0)
    stream = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(source, read_across_frames=True, read_size=1 << 20)
    buf, at = b"", 0

    def more(n: int) -> bool:
        nonlocal buf, at
        while len(buf) - at < n:
            got = stream.read(max(1 << 20, n))
            if not got:
                return False
            buf, at = buf[at:] + got, 0
        return True

    def line_end(sep: bytes) -> int:
        have = 1
        while (i := buf.find(sep, at)) < 0:
            have = len(buf) - at + 1
            if not more(have):
                raise ValueError("a record breaks off")
        return i

    while more(1):
        i = line_end(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in buf[at:i].decode().split("\r\n")[1:])
        at = i + 4
        n = int(fields["Content-Length"])
        if not more(n + 4):
            raise ValueError("a record breaks off")
        http, _, payload = buf[at : at + n].partition(b"\r\n\r\n")
        at += n + 4
        length = int(http.rsplit(b"Content-Length: ", 1)[1])
        if fields["WARC-Type"] == "response" and (len(payload) != length or "sha1:" + digest(payload) != fields["WARC-Payload-Digest"]):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
        yield fields | {"length": length, "payload": payload}


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, digest_hex, refers_to)`` of the pages whose payload a larger page_id has too."""
    known = _with_digest(pages).where(F.col("page_id").isNotNull() & (F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes))
    known = known.select("page_id", "digest_hex")
    largest = known.groupBy("digest_hex").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return known.join(largest, "digest_hex").where("page_id < refers_to").select("page_id", "digest_hex", "refers_to").distinct()


def _with_digest(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("digest_hex"))


def write_archives(
    pages: DataFrame, folder: str, archive_bytes: int = 32 << 20, level: int = 3, dictionary_bytes: int = 64 << 10, sample_bytes: int = 2 << 20, least_bytes: int = 0
) -> DataFrame:
    """Archive every page; returns the manifest ``(file, records)``, run once and kept, a row per archive."""

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, held, size, made = TaskContext.get().partitionId(), [], 0, []

        def close() -> None:
            name = f"part-{part:06d}-{len(made):05d}.warc.zst"
            write_archive(folder, name, held, level, dictionary_bytes, sample_bytes)
            made.append((name, len(held)))

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    held.append(record(row[0], row[1] or "", (row[2] or "").encode(), row[3]))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        close()
                        held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_pydict({"file": [m[0] for m in made], "records": [m[1] for m in made]}, pa.schema([("file", pa.string()), ("records", pa.int64())]))

    dealt = _with_digest(pages).join(revisits(pages, least_bytes), ["page_id", "digest_hex"], "left")
    return durable(dealt.select("page_id", "url", "html", "refers_to").mapInArrow(write, "file string, records long"))


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Read archives back, a task per archive at most: the record's fields, and the payload if asked for."""

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with open_input(folder, name) as source:
                    for r in read_archive(source):
                        rows.append(
                            (_page(r["WARC-Record-ID"]), r["WARC-Target-URI"], r["length"], r["WARC-Payload-Digest"][5:], r["WARC-Type"], _page(r.get("WARC-Refers-To")), *([r["payload"]] * with_payload))
                        )
                        if len(rows) == 500:
                            yield _batch(pa, rows, kinds)
                            rows = []
                if rows:
                    yield _batch(pa, rows, kinds)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return manifest.select("file").repartition("file").mapInArrow(read, kinds)


def _page(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").removeprefix(ID)
    return int(tail) if tail else None


def _batch(pa, rows: list[tuple], kinds: str):
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [k.split(" ") for k in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def op2_warc(spark, sf_dir) -> DataFrame:
    """Archive all pages, then report every record as read back."""
    folder = new_folder(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(hex_text: str) -> str:
    """SQL for the base32 of 40 hex digits: five digits are four letters."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    out = []
    for i in range(8):
        n = f"CAST('0x' || substr({hex_text}, {5 * i + 1}, 5) AS INTEGER)"
        out += [f"substr({letters}, (({n}) >> {s}) % 32 + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(out)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
     k AS (SELECT d, max(page_id) AS keep FROM p GROUP BY d)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, {_base32_sql('p.d')} AS payload_digest,
       CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keep THEN keep END AS refers_to
FROM p JOIN k USING (d)
"""
