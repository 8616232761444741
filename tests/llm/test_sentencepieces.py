import struct
import zlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.sentencepieces import MARK, Codec, encode_documents, op10_sentencepiece
from quarry.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def codec():
    return Codec(vocabulary("piece_bpe_32k.model"), entries=300)


def ids_of(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


@settings(max_examples=800, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(f" \n\t the,.éЖ中🙂{MARK}\0a1"), max_size=30), max_size=4))
def test_parity_with_the_library(codec, texts):
    ids, parity = codec.encode(texts)
    want = codec.check.encode(texts)
    assert [ids_of(b) == w for b, w in zip(ids, want, strict=True)] == parity
    assert all(parity)
    assert codec.decode(ids) == [t.replace(MARK, " ") for t in texts]


def test_unigram_model_is_rebuilt(tmp_path):
    """A model file written here by hand: unigram scores, no byte fallback, extra spaces removed."""
    varint = lambda n: bytes([n & 127 | 128, n >> 7]) if n > 127 else bytes([n])
    field = lambda f, b: varint(f << 3 | 2) + varint(len(b)) + b
    piece = lambda p, s, k: field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k]))
    raw = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    for p, s in ((MARK, -3.0), ("a", -2.5), ("b", -2.7), ("ab", -3.1), (MARK + "a", -3.3), ("ba", -4.0), ("bab", -4.4)):
        raw += piece(p, s, 1)
    raw += field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x01\x28\x01")
    path = tmp_path / "m.model"
    path.write_bytes(raw)
    codec = Codec(str(path))
    texts = ["ab  ba bab", " abab ", "xbax", "", "aab  b"]
    ids, parity = codec.encode(texts)
    assert not codec.cuttable and all(parity)
    assert [ids_of(b) for b in ids] == sentencepiece.SentencePieceProcessor(model_file=str(path)).encode(texts)


def test_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = op10_sentencepiece(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and all(r.parity for r in got)
    for r in got:
        ids = sp.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_odd_rows(spark):
    rows = [(1, None, True), (1, "", False), (None, "a  b", True), (2, "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, parity boolean")
    got = encode_documents(df).collect()
    assert sorted((r.doc_id or 0, r.text_back) for r in got) == [(0, "a  b"), (1, ""), (1, ""), (2, "x" * 200_000)]
    assert encode_documents(df.limit(0)).count() == 0
