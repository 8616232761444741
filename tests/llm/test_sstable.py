import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.files import AtomicFile, open_input
from quarry.llm.sstable import TableReader, TableWriter, key_of, op8_token_tables, token_tables
from quarry.llm.tokens import ChunkEncoder, vocabulary


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(vocabulary(), entries=500)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r'sTé1.,<|>_    \x1c中á½\0"), max_size=40), max_size=4))
def test_encoder_is_exact(encoder, texts):
    plain = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in encoder.encode(texts)] == plain


def test_encoder_on_documents(encoder):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    plain = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in encoder.encode(texts)] == plain


def test_look_up(tmp_path):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(-5000, 5000), 900))
    w = TableWriter(AtomicFile(str(tmp_path), "t.sst"), block_bytes=300)
    want = {}
    w.add(b"", b"")
    for k in keys:
        ids = struct.pack("<3I", k & 0xFFFF, 1, 70_000 if k % 2 else 2)
        for _ in range(5 if k % 97 == 0 else 1):
            w.add(key_of(k), ids)
            want.setdefault(k, []).append(ids)
    w.close()
    r = TableReader(open_input(str(tmp_path), "t.sst"))
    assert [k for k, _ in r] == [b""] + [key_of(k) for k, v in want.items() for _ in v]
    for k in range(-5000, 5000, 7):
        assert r.get(key_of(k)) == want.get(k, [])
    assert r.get(b"") == [b""] and len(r.index) > 20


def test_round_trip(spark, encoder):
    rows = [(5, "a b  c   d\n\n", "x"), (-3, None, "x"), (9, "", None), (7, "wörd " * 30_000, "x"), (5, "a b  c   d\n\n", "y"), (None, "n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = token_tables(docs).orderBy("start").collect()
    ids = [encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]
    assert [r.doc_id for r in got] == [None, -3, 5, 5, 7, 9]
    assert [list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) for r in got] == ids
    assert [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(6)]
    assert zlib.crc32(bytes(got[0].ids)) == zlib.crc32(struct.pack(f"<{len(ids[0])}I", *ids[0]))


def test_query_against_the_library(spark, encoder):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op8_token_tables(spark, sf).collect()}
    at = 0
    assert got.keys() == texts.keys()
    for k in sorted(texts):
        ids = encoder.tokenizer.encode(texts[k], add_special_tokens=False).ids + [0]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_empty(spark):
    assert token_tables(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_encoder_starts_no_threads():
    """Each would keep memory of its own in every worker; a task has one core."""
    import os
    import subprocess
    import sys

    code = (
        "import os, numpy, pyarrow.compute\n"
        "from quarry.llm.tokens import ChunkEncoder, vocabulary\n"
        "texts = [f'word{i} some text {i}' for i in range(5000)]\n"
        "with ChunkEncoder.of(vocabulary()) as e:\n"
        "    n = len(os.listdir('/proc/self/task'))\n"
        "    e.encode(texts), e._whole(texts)\n"
        "    print(len(os.listdir('/proc/self/task')) - n)"
    )
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"RAYON_NUM_THREADS": "4", "PYTHONPATH": os.getcwd()}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120).stdout.strip() == "0"
