"""Operator 9: near-duplicate vectors by a pigeonhole over subspaces.

Unit vectors of cosine c lie at squared distance 2 - 2c. They are rotated by a fixed random rotation and split
into blocks of a few components; each block gets a share of that squared distance in proportion to its
width, so a linked pair is within its share in one block at least. Each block is range-joined: its first
components are cut into a grid, a vector goes to every cell that a box of half the range around it touches,
and a pair is looked at in one cell, that of its larger corners. Pairs within a block's share are
verified by their cosine in double precision and counted in the first block that has them.

Equal vectors of one label are one class, so copies cost nothing. A crowded cell is dealt to pairs of parts
of bounded size. A unit gives each class its number of links and a spanning forest, never all pairs.

Vectors link within equal non-null labels and equal lengths. Null or empty ones, zeros, those with null or
non-finite components and rows without a vec_id or label link with nothing. Each row is a vector of its own, also
where vec_id repeats. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.groups import forest, groups, units
from quarry.llm.topk import usable
from quarry.operators.components import connected_components
from quarry.session import durable

WIDTH, GRID, SLACK = 8, 4, 1e-9
KEY = ["label", "dim", "block", "cell"]


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _blocks(dim: int) -> list[slice]:
    return [slice(a, min(a + WIDTH, dim)) for a in range(0, dim, WIDTH)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cells(classes: DataFrame, budget: float) -> DataFrame:
    """Each class in each cell its box touches; ``corner`` has a bit for each
    grid component in which the cell is above the box's lower corner."""

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            node, label, vector, mult = batch.columns
            dims = np.diff(vector.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                flat = vector.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim)
                turned = _unit(flat) @ rotation(dim)
                raw = pa.array([x.tobytes() for x in flat.astype(np.float32)], pa.binary())
                for b, block in enumerate(_blocks(dim)):
                    x = turned[:, block][:, :GRID]
                    r = np.sqrt(budget * (block.stop - block.start) / dim) * (1 + 1e-6)
                    low, high = np.floor((x - r / 2) / (2 * r)), np.floor((x + r / 2) / (2 * r))
                    width = x.shape[1]
                    for mask in range(1 << width):
                        bits = np.array([mask >> i & 1 for i in range(width)])
                        at = np.flatnonzero(((low + bits) <= high).all(axis=1))
                        if not len(at):
                            continue
                        coords = (low[at] + bits).astype(np.int64) + 32768
                        cell = sum(coords[:, i] << 16 * i for i in range(width))
                        back = pa.array(at)
                        out = [label.take(pa.array(rows[at])), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), b, np.int32)), pa.array(cell), pa.array(np.full(len(at), mask, np.int32))]
                        out += [node.take(pa.array(rows[at])), mult.take(pa.array(rows[at])), raw.take(back), pa.array(np.ones(len(at), bool))]
                        yield pa.RecordBatch.from_arrays(out, names=[*KEY, "corner", "node", "mult", "vector", "home"])

    kinds = "label long, dim int, block int, cell long, corner int, node long, mult long, vector binary, home boolean"
    return classes.select("node", "label", "embedding", "mult").mapInArrow(go, kinds)


def _links_in(vectors, corner, part, split, block: int, least: float, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one unit that this block is the first to have within its share, and whose cosine is enough."""
    dim, n = vectors.shape[1], len(vectors)
    blocks = _blocks(dim)
    unit = _unit(vectors)
    turned = unit @ rotation(dim)
    share = np.array([budget * (s.stop - s.start) / dim for s in blocks]) * (1 + SLACK) + 1e-12
    x = turned[:, blocks[block]]
    sq = (x * x).sum(axis=1)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, n, 256):
        rows = slice(a, min(a + 256, n))
        near = sq[rows, None] + sq[None, :] - 2 * (x[rows] @ x.T) <= share[block] + 1e-9
        near &= (corner[rows, None] & corner[None, :]) == 0
        near &= np.arange(n)[None, :] > np.arange(a, rows.stop)[:, None]
        if split:
            near &= part[rows, None] != part[None, :]
        i, j = np.nonzero(near)
        i += a
        for s in range(0, len(i), 50_000):
            p, q = i[s : s + 50_000], j[s : s + 50_000]
            v, w = vectors[p].astype(np.float64), vectors[q].astype(np.float64)
            cos = (v * w).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((w * w).sum(axis=1)))
            keep = cos >= least
            p, q = p[keep], q[keep]
            apart = (turned[p] - turned[q]) ** 2
            within = np.stack([apart[:, s].sum(axis=1) for s in blocks], axis=1) <= share
            first = within.argmax(axis=1) == block
            left.append(p[first])
            right.append(q[first])
    return np.concatenate(left), np.concatenate(right)


def class_links(classes: DataFrame, least: float, most: int = 768) -> DataFrame:
    """Rows ``(a, b, n)``: a class's number of linked vectors in a unit (b null), or a spanning link (n null)."""
    budget = 2 - 2 * least

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for t, spans in groups(batches, [*KEY, "low", "high"]):
            c = {k: t[k].to_numpy() for k in ("node", "mult", "corner", "part", "dim", "block", "low", "high")}
            raw = t["vector"].combine_chunks() if t.num_rows else None
            a_out, b_out, n_out = [], [], []
            for a, b in spans:
                s, dim = slice(a, b), int(c["dim"][a])
                v = np.frombuffer(b"".join(raw[a:b].to_pylist()), np.float32).reshape(-1, dim)
                i, j = _links_in(v, c["corner"][s], c["part"][s], c["low"][a] != c["high"][a], int(c["block"][a]), least, budget)
                if not len(i):
                    continue
                node, mult = c["node"][s], c["mult"][s]
                n = np.bincount(i, mult[j], b - a) + np.bincount(j, mult[i], b - a)
                some = np.flatnonzero(n)
                near = np.zeros((b - a, b - a), dtype=bool)
                near[i, j] = near[j, i] = True
                links = forest(near)
                a_out += [*node[some].tolist(), *(int(node[p]) for p, _ in links)]
                b_out += [*[None] * len(some), *(int(node[q]) for _, q in links)]
                n_out += [*n[some].astype(np.int64).tolist(), *[None] * len(links)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a_out, b_out, n_out)], names=["a", "b", "n"])

    return units(_cells(classes, budget), KEY, "node", most).mapInArrow(go, "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    some = usable(rows).where(F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0))
    # a class is a node of its own, so that different vectors of one vec_id stay apart
    classes = durable(some.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult")).withColumn("node", F.monotonically_increasing_id()))
    found = durable(class_links(classes, least))
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of_node = connected_components(found.where("b IS NOT NULL").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    of_class = (
        classes.join(counted, "node", "left")
        .join(of_node, "node", "left")
        .select("label", "embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    known = of_class.join(of_class.groupBy("component").agg(F.min("least").alias("c")), "component").select("label", "embedding", "n_links", "c")
    linked = some.join(known, ["label", "embedding"]).select("vec_id", "n_links", F.col("c").alias("component_id"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    none = F.coalesce(F.col("vec_id").isNull() | F.col("embedding").isNull() | F.col("label").isNull() | bad, F.lit(True))
    single = rows.where(none).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_vector_neardup(spark, sf_dir) -> DataFrame:
    """Links and components of all vectors at cosine 0.98."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
