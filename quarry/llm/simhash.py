"""Operator 3: near-duplicates by 64-bit SimHash fingerprints and anchor points.

Two fingerprints that differ in at most three bits differ in at most one bit of one 32-bit half. The anchors of
a half are the words of a covering code of radius 1: the perfect Hamming code on 31 bits beside one free
bit. A half's home is the anchor nearest to it; a half one bit away lies within radius plus threshold, two
bits, of that home. So every different fingerprint goes to the at most 17 anchors of each half within two bits,
and is compared with the others there if one of them is at home. Copies of a fingerprint count once.

Each anchor's rows yield a spanning forest of the links between them, never all pairs; large anchors
are dealt to pairs of parts of bounded size. The links feed a distributed connected-components loop.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.groups import forest, groups, units
from quarry.operators.components import connected_components
from quarry.session import durable

DISTANCE = 3
_LANES = np.uint64(0x0101010101010101)
#: Positions (1 to 31) by bit of their number: parity over each set gives the syndrome of the Hamming code.
_CHECKS = [np.uint32(sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1)) for j in range(5)]
#: For each syndrome, the pairs of bits whose numbers differ by it: the ways to a code word two bits away.
_PAIRS = np.array([[1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s < 32] or [0] * 15 for s in range(32)], dtype=np.uint32)


def fingerprints_of(texts: list[str], size: int = 3) -> np.ndarray:
    """SimHash of each whole text over the XXH64 (seed 42) of its word shingles, repeats included."""
    return tables_of(texts, size, 1)[:, 0]


def _mixed(h: np.ndarray, table: int) -> np.ndarray:
    """The hashes themselves for table 0; for another, hashes of them that have nothing to do with those of the rest."""
    if table == 0:
        return h
    z = h + np.uint64(table * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def tables_of(texts: list[str], size: int, tables: int) -> np.ndarray:
    """Texts by tables: independent SimHashes of each text, all over the same shingles."""
    from xxhash import xxh64_intdigest

    hashes, counts = array("Q"), []
    for text in texts:
        words = text.encode().lower().split()  # on bytes: A-Z alone, and the six ASCII white-space bytes
        if len(words) > size:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[:-size].tolist()]
            joined = b" ".join(words)
            hashes.extend([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)])
            counts.append(len(starts))
        else:
            counts.append(1 if words else 0)
            if words:
                hashes.append(xxh64_intdigest(b" ".join(words), 42))
    out = np.zeros((len(texts), tables), dtype=np.uint64)
    n = np.array(counts, dtype=np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    h = np.frombuffer(hashes, np.uint64)
    n = n[some]
    # sums of one bit in each byte lane, over runs of at most 255 hashes of one text
    runs = -(-n // 255)
    first = np.cumsum(n) - n
    of_run = np.repeat(np.cumsum(runs) - runs, runs)
    at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - of_run)
    seg = np.cumsum(runs) - runs
    for table in range(tables):
        ht = _mixed(h, table)
        for bit in range(8):
            lanes = np.add.reduceat((ht >> np.uint64(bit)) & _LANES, at)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), seg, axis=0)
            for lane in range(8):
                out[some, table] |= (2 * ones[:, lane] > n).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprints(docs: DataFrame, size: int = 3, tables: int = 1) -> DataFrame:
    """``(doc_id, fps)`` per row; ``fps`` has the 64 bits of each table as a signed long. Null text has no words."""

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fps = tables_of([t or "" for t in part.column(1).to_pylist()], size, tables)
                ends = pa.array(np.arange(0, fps.size + 1, tables, dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(fps.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "fps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, fps array<long>")


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit halves -> (anchors within two bits, which of them exist); the first column is the home."""
    x = half & np.uint32(0x7FFFFFFF)
    free = half & np.uint32(0x80000000)
    s = sum(((np.bitwise_count(x & m) & 1).astype(np.int64) << j) for j, m in enumerate(_CHECKS))
    home = np.where(s > 0, x ^ (np.uint32(1) << np.maximum(s - 1, 0).astype(np.uint32)), x).astype(np.uint32)
    near = x[:, None] ^ _PAIRS[s]
    all_of = np.concatenate([home[:, None], home[:, None] ^ np.uint32(0x80000000), near], axis=1) ^ free[:, None]
    there = np.ones(all_of.shape, dtype=bool)
    there[:, 2:] = (s > 0)[:, None]
    return all_of, there


def _anchor_rows(different: DataFrame) -> DataFrame:
    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            node, fp, table = (batch.column(i).to_numpy() for i in (0, 1, 2))
            bits = fp.view(np.uint64)
            for side in (0, 1):
                all_of, there = anchors_of((bits >> np.uint64(32 * side)).astype(np.uint32))
                row, col = np.nonzero(there)
                cell = all_of[row, col].astype(np.int64) | side << 32 | table[row].astype(np.int64) << 33
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(node[row]), pa.array(fp[row]), pa.array(col == 0)], names=["cell", "node", "fp", "home"]
                )

    if "table" not in different.columns:
        different = different.withColumn("table", F.lit(0))
    return different.select("node", "fp", "table").mapInArrow(go, "cell long, node long, fp long, home boolean")


def links(different: DataFrame, most: int = 1024) -> DataFrame:
    """Spanning links ``(src, dst)`` between nodes whose fingerprints (of one ``table``, if there are more) differ in at most three bits."""

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for t, spans in groups(batches, ["cell", "low", "high"]):
            node, fp = t["node"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
            at = np.array([a for a, b in spans if b - a == 2], dtype=np.int64)
            two = at[np.bitwise_count(fp[at] ^ fp[at + 1]) <= DISTANCE]
            src, dst = [node[two]], [node[two + 1]]
            for a, b in spans:
                if b - a > 2:
                    near = np.bitwise_count(fp[a:b, None] ^ fp[None, a:b]) <= DISTANCE
                    if near.sum() > b - a:
                        pairs = np.array(forest(near), dtype=np.int64).reshape(-1, 2) + a
                        src.append(node[pairs[:, 0]])
                        dst.append(node[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    dealt = units(_anchor_rows(different), ["cell"], "fp", most, "n > 1 AND homes > 0")
    return dealt.mapInArrow(go, "src long, dst long")


def near_duplicates(docs: DataFrame, size: int = 3, tables: int = 1) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``; ``fp`` is the fingerprint of the first table.

    Null and empty texts have fingerprint 0, which links like any other. Rows without a doc_id keep their
    fingerprint, link nothing and have no component. A repeated doc_id is not a link of its own: each row is
    placed by its fingerprint. No rows give no rows; other columns are ignored.

    Texts of less likeness differ in more than three bits of most fingerprints; with more ``tables``, texts that
    are within three bits in any of these independent fingerprints are linked.
    """
    own = durable(fingerprints(docs, size, tables))
    # a fingerprint is its own node, so that rows of one doc_id and different texts stay apart
    node = F.col("fps")[0] if tables == 1 else F.xxhash64("fps")
    different = durable(own.where("doc_id IS NOT NULL").groupBy("fps").agg(F.min("doc_id").alias("least")).withColumn("node", node))
    each = different.select("node", F.posexplode("fps").alias("table", "fp"))
    if tables == 1:
        edges = links(each)
    else:
        first = durable(each.groupBy("table", "fp").agg(F.min("node").alias("node")))
        same = each.join(first.withColumnRenamed("node", "first"), ["table", "fp"]).where("node <> first")
        edges = links(first).unionByName(same.select(F.col("node").alias("src"), F.col("first").alias("dst")))
    of_node = different.join(connected_components(edges), "node", "left").select("fps", "least", F.coalesce("component", "node").alias("c"))
    of_fp = of_node.join(of_node.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fps", "component_id")
    found = own.join(of_fp, "fps", "left")
    return found.select("doc_id", F.col("fps")[0].alias("fp"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op3_simhash(spark, sf_dir) -> DataFrame:
    """Fingerprints and components of all documents."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
