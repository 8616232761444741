"""Operator 10: SentencePiece encoding and decoding on the tokenizers library.

The model file is read as protobuf here. From it a tokenizer is rebuilt: the normaliser (compiled character map, extra
spaces, dummy prefix, the marker for spaces), the pieces with their scores as a unigram model, or as
a BPE model whose merges are ranked by piece score, and byte fallback. Batches go through the library's threads.

Where no piece has the marker after another character, nor a line break, texts can be cut before a marker
and around line breaks without changing the result; each different cut is encoded once and remembered, and
checked against the sentencepiece library there (``parity``). Texts with runs of spaces or literal markers,
and models whose pieces or normaliser do not allow cuts, are encoded and checked whole.

Null text is an empty text and has no ids. Decoding joins pieces, takes byte pieces as UTF-8 and drops the
dummy prefix. Each row of a repeated doc_id is encoded by itself; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import cut_and_code, gather, in_batches, vocabulary

MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = buf[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(buf):
        key = varint()
        field, wire = key >> 3, key & 7
        if wire == 0:
            yield field, varint()
        elif wire == 2:
            n = varint()
            yield field, buf[at : at + n]
            at += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield field, struct.unpack("<d" if wire == 1 else "<f", buf[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"wire type {wire} in the model file")


class Model:
    """What encoding needs of a SentencePiece model file."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.type = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.remove_extra = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        if self.type not in (UNIGRAM, BPE) or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models with the marker before words are rebuilt")

    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

        kinds = [k for _, _, k in self.pieces]
        if self.type == UNIGRAM:
            pieces = [(p, s if k in (NORMAL, USER_DEFINED) else -1e9) for p, s, k in self.pieces]
            t = Tokenizer(models.Unigram(pieces, unk_id=self.unk, byte_fallback=self.byte_fallback))
        else:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            usable = {p for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED)}
            merges = []
            for i, (p, s, k) in enumerate(self.pieces):
                if k == NORMAL:
                    ways = [(p[:c], p[c:]) for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable]
                    merges += [(-s, i, ids[a], ids[b], (a, b)) for a, b in ways]
            merges.sort()
            model = models.BPE(ids, [m[4] for m in merges], unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
            t = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(True, True)]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            t.normalizer = normalizers.Sequence(steps)
        t.add_tokens([AddedToken(p, normalized=False) for (p, _, _), k in zip(self.pieces, kinds, strict=True) if k == USER_DEFINED])
        return t

    def cuts(self) -> bool:
        """Whether no piece spans a place before a marker or beside a line break, and text is taken as it is."""
        spans = any(re.search(f"[^{MARK}]{MARK}|\n", p) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED))
        own = any(k == USER_DEFINED for _, _, k in self.pieces)
        return not (spans or own or self.charsmap or self.remove_extra) and self.dummy_prefix and self.escape and self.byte_fallback

    def piece_bytes(self) -> list[bytes]:
        def of(p: str, k: int) -> bytes:
            if k == BYTE:
                return bytes([int(p[3:5], 16)])
            return b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()

        return [of(p, k) for p, _, k in self.pieces]


_LOADED: dict[str, Codec] = {}


class Codec:
    """Encodes and decodes batches in one worker process. About ``entries`` cuts are remembered."""

    def __init__(self, path: str, entries: int = 400_000) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.tokenizer = self.model.tokenizer()
        self.plain = self.model.tokenizer()  # for cuts: they are in normal form already
        self.plain.normalizer = None
        if self.model.type == BPE:
            self.plain.model._resize_cache(0)
        self.check = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cuttable, self.pieces = self.model.cuts(), self.model.piece_bytes()
        self.entries, self.cache, self.differs = entries, {}, set()

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        got = [ids if t else [] for t, ids in zip(texts, got, strict=True)]
        want = self.check.encode(texts, num_threads=1) if texts else []
        return [(array("I", a).tobytes(), a == b) for a, b in zip(got, want, strict=True)]

    def _learn(self, cuts: list[str]) -> None:
        ids = [array("I", x.ids).tobytes() for x in self.plain.encode_batch_fast(cuts, add_special_tokens=False)]
        # the library puts the dummy prefix before any text, so a cut is checked behind a line break
        asked = ["\n" + c.replace(MARK, " ") for c in cuts]
        front = array("I", self.check.encode("\n")).tobytes()
        for cut, got, want in zip(cuts, ids, self.check.encode(asked, num_threads=1) if asked else [], strict=True):
            if front + got != array("I", want).tobytes():
                self.differs.add(cut)
        self.cache.update(zip(cuts, ids, strict=True))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids as little-endian unsigned 32-bit, and whether they are those of the sentencepiece library."""
        odd = lambda t: not t or t[0] == " " or "  " in t or MARK in t or "\0" in t
        whole = [i for i, t in enumerate(texts) if not self.cuttable or odd(t)]
        known = dict(zip(whole, self._whole([texts[i] for i in whole]), strict=True))
        rest = [i for i in range(len(texts)) if i not in known]
        if len(self.cache) > self.entries:
            self.cache.clear()
            self.differs.clear()
        words, code, offsets, _ = cut_and_code([MARK + texts[i] for i in rest], (("\n", "\0\n\0"), (" ", "\0" + MARK)))
        self.cache[""] = b""
        self._learn([w for w in words if w not in self.cache])
        for i, ids in zip(rest, gather([self.cache[w] for w in words], code, offsets), strict=True):
            known[i] = (ids, True)
        if bad := self.differs.intersection(words):
            for i in rest:
                cut = (MARK + texts[i]).replace("\n", "\0\n\0").replace(" ", "\0" + MARK).split("\0")
                known[i] = (known[i][0], bad.isdisjoint(cut))
        return [known[i][0] for i in range(len(texts))], [known[i][1] for i in range(len(texts))]

    def decode(self, ids: list[bytes]) -> list[str]:
        import numpy as np

        code = np.frombuffer(b"".join(ids), "<u4")
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
        texts = [b.decode("utf-8", errors="replace") for b in gather(self.pieces, code, offsets, unit=1)]
        return [t[1:] if self.model.dummy_prefix and t[:1] == " " else t for t in texts]


def encode_documents(docs: DataFrame, model: str | None = None, decoded: bool = True) -> DataFrame:
    """``(doc_id, ids, parity, text_back)`` per row; ``text_back`` is decoded from the ids (null unless asked for)."""
    path = model or vocabulary("piece_bpe_32k.model")

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        codec = Codec.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for span in in_batches(texts, 3_000_000):
                part = texts[span.start : span.stop]
                ids, parity = codec.encode(part)
                back = codec.decode(ids) if decoded else [None] * len(part)
                cols = [batch.column(0).slice(span.start, len(part)), pa.array(ids, pa.binary()), pa.array(parity), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "parity", "text_back"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        go, "doc_id long, ids binary, parity boolean, text_back string"
    )


def op10_sentencepiece(spark, sf_dir) -> DataFrame:
    """All documents encoded with the 32k piece model and decoded again, with checksums of both."""
    got = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "parity", F.md5("text_back").alias("decoded_md5")
    )
