"""Operator 8: token ids in sorted-string-table shards.

File: magic, data blocks, block index, Bloom filter, footer. Keys are identifiers as 8 big-endian
bytes with the sign bit flipped (null: the empty key, first of all), so byte order is numeric
order. A data block is a Zstandard frame of entries ``shared, rest, value length, rest of key,
value``: the key without the prefix it shares with the key before. The index has the last key and
place of each block; a look-up asks the filter, bisects the index and reads one block.

Documents are dealt to shards by ranges of (doc_id, hash of text), so that repeated identifiers
may span shards. Null text is an empty document (it holds the end id alone). A repeated doc_id keeps
all its rows, in the order of their texts' hashes. No rows: no shards. Other columns are ignored.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.files import AtomicFile, new_folder, open_input
from quarry.llm.tokens import ChunkEncoder, text_batches, vocabulary
from quarry.session import durable

MAGIC = b"QSSTBL01"
FOOTER = struct.Struct("<QQQQQQ8s")  # index at, index bytes, filter at, filter bytes, entries, tokens
_FLIP = 1 << 63


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + _FLIP).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - _FLIP if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, hashes: int) -> list[int]:
    from xxhash import xxh3_128_intdigest

    h = xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class TableWriter:
    """Entries in ascending key order; equal keys may follow each other."""

    def __init__(self, out: AtomicFile, block_bytes: int = 256 << 10, bits_per_key: int = 10, level: int = 1) -> None:
        import zstandard

        self.out, self.block_bytes, self.bits_per_key = out, block_bytes, bits_per_key
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.block, self.size, self.last = [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        out.write(MAGIC)

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit; stored in 16 bits where all fit."""
        import numpy as np

        a = np.frombuffer(ids, "<u4")
        narrow = not len(a) or int(a.max()) < 1 << 16
        value = (b"\2" + a.astype("<u2").tobytes()) if narrow else b"\4" + ids
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block.append(_varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value)
        self.size += len(self.block[-1])
        self.last = key
        self.keys.append(key)
        self.tokens += len(a)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            frame = self.zstd.compress(b"".join(self.block))
            self.index.append((self.last, self.out.write(frame), len(frame)))
            self.block, self.size = [], 0

    def close(self, hashes: int = 7) -> None:
        import numpy as np

        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        index_at = self.out.write(index)
        bits = max(64, self.bits_per_key * len(self.keys) + 7 & ~7)
        filled = np.zeros(bits, dtype=np.uint8)
        for k in self.keys:
            filled[_probes(k, bits, hashes)] = 1
        bloom = bytes([hashes]) + np.packbits(filled, bitorder="little").tobytes()
        bloom_at = self.out.write(bloom)
        self.out.write(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), len(self.keys), self.tokens, MAGIC))
        self.out.close()


class TableReader:
    """Reads one shard: all of it in order, or the values of one key."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.size()
        source.seek(end - FOOTER.size)
        i_at, i_n, b_at, b_n, self.entries, self.tokens, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table shard")
        raw, at, self.index = self._at(i_at, i_n), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQ", raw, at + n)))
            at += n + 16
        self.bloom = self._at(b_at, b_n)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, at: int, n: int) -> Iterator[tuple[bytes, bytes]]:
        import numpy as np

        raw, p, key = self.zstd.decompress(self._at(at, n)), 0, b""
        while p < len(raw):
            shared, p = _read_varint(raw, p)
            rest, p = _read_varint(raw, p)
            size, p = _read_varint(raw, p)
            key = key[:shared] + raw[p : p + rest]
            value = raw[p + rest : p + rest + size]
            p += rest + size
            ids = value[1:]
            yield key, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if value[0] == 2 else ids

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, n in self.index:
            yield from self._block(at, n)

    def get(self, key: bytes) -> list[bytes]:
        bits = 8 * (len(self.bloom) - 1)
        if not all(self.bloom[1 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits, self.bloom[0])):
            return []
        found, i = [], bisect_left(self.index, key, key=lambda e: e[0])
        while i < len(self.index):
            own = [v for k, v in self._block(*self.index[i][1:]) if k == key]
            found += own
            if self.index[i][0] != key:
                break
            i += 1
        return found


def write_tables(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """Encode whole texts and write one shard per range of identifiers.

    Returns the manifest ``(shard int, file, entries long, tokens long)``: one row per shard, so as
    many as tasks. It is run once and kept (files are renamed into place, a retried task replaces its own).
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        name = f"shard-{shard:06d}.sst"
        with ChunkEncoder.of(tokenizer) as encoder:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for span, texts in text_batches(batch.column(1)):
                    for i, got in zip(span, encoder.encode(texts), strict=True):
                        out = out or TableWriter(AtomicFile(folder, name))
                        out.add(key_of(ids[i]), got + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "file": [name], "entries": [len(out.keys)], "tokens": [out.tokens]}, _MANIFEST_ARROW()
            )

    sorted_docs = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
    )
    return durable(sorted_docs.select("doc_id", "text").mapInArrow(write, "shard int, file string, entries long, tokens long"))


def _MANIFEST_ARROW():
    import pyarrow as pa

    return pa.schema([("shard", pa.int32()), ("file", pa.string()), ("entries", pa.int64()), ("tokens", pa.int64())])


def read_tables(manifest: DataFrame, folder: str) -> DataFrame:
    """Read shards back: ``(shard, doc_id, start long, ids binary)``; ``start`` counts the ids before it in all shards.

    The manifest (one row per shard) is summed up on the driver; documents are not.
    """
    spark = manifest.sparkSession
    rows, total = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], r["file"], total))
        total += r["tokens"]
    places = spark.createDataFrame(rows, "shard int, file string, start long")
    places = places.repartition(max(1, len(rows))) if rows else places

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, name, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out: tuple[list, list, list] = ([], [], [])
                held = 0
                with open_input(folder, name) as source:
                    for key, ids in TableReader(source):
                        for c, v in zip(out, (id_of(key), start, ids), strict=True):
                            c.append(v)
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 8 << 20:
                            yield _rows(pa, shard, *out)
                            out, held = ([], [], []), 0
                if out[0]:
                    yield _rows(pa, shard, *out)

    return places.mapInArrow(read, "shard int, doc_id long, start long, ids binary")


def _rows(pa, shard, keys, starts, ids):
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
        names=["shard", "doc_id", "start", "ids"],
    )


def token_tables(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 0) -> DataFrame:
    """Write the shards of ``docs`` to a new shared folder and read them back."""
    folder = new_folder(docs.sparkSession, "sstable")
    return read_tables(write_tables(docs, folder, tokenizer or vocabulary(), end_id), folder)


def op8_token_tables(spark, sf_dir) -> DataFrame:
    """Every document's place, length and checksum as read back from the shards."""
    got = token_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "shard"
    )
