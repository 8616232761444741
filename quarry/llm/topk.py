"""Operator 1: exact top-k inner products by the threshold algorithm over sorted lists.

Every candidate lies in one block of bounded size. For each block and component there is a list of its rows in
the order of that component. A query reads its lists from the end that adds most, a few ranks at a
time, scores each row it meets in full, and stops in that block once the bound (the sum of what each
list could still add) is below its kth score. Blocks of queries meet blocks of candidates in Spark; the
k best of each block are merged per query. Scores are integers, ties go to the smaller id.

Components are floor(scale * x) of the component as a double. Vectors that are null or hold null or non-finite
components take no part; a shorter vector counts as if filled up with zeros. Null ids take no part.
A repeated id is a row of its own, but never an answer to a query of the same id; queries of one id and different vectors
have k answers each, equal queries are one. Fewer candidates than k: all of them. No rows or no queries: no rows.
A score that 64 bits might not hold is an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


class Lists:
    """A block of candidates with one sorted list of rows per component."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        self.up = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(values.T, self.up, axis=1)
        self.floats = values.astype(np.float64)
        self.largest = int(np.abs(values).max(initial=0))

    def exact(self, q: np.ndarray) -> bool:
        """Whether every partial sum is an integer that a double holds exactly."""
        most = self.largest * int(np.abs(q).sum())
        if most >= 1 << 63:
            raise OverflowError("scores of these vectors do not fit in 64 bits")
        return most < 1 << 53

    def best(self, q: np.ndarray, own: int, k: int, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows for ``q`` other than ``own``, best first."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        w = q[dims]
        down = w > 0  # a positive weight reads its list from the largest value
        seen = np.zeros(n, dtype=bool)
        ids = np.empty(0, np.int64)
        scores = np.empty(0, np.int64)
        low, high = 0, min(step, n)
        while True:
            if len(dims):
                at = np.where(down[:, None], n - 1 - np.arange(low, high), np.arange(low, high))
                met = seen.copy()
                met[self.up[dims[:, None], at]] = True
            else:
                met = np.ones(n, dtype=bool)
            rows = np.flatnonzero(met & ~seen)
            seen = met
            rows = rows[self.ids[rows] != own]
            ids = np.concatenate([ids, self.ids[rows]])
            got = (self.floats[rows] @ q.astype(np.float64)).astype(np.int64) if self.exact(q) else self.values[rows] @ q
            scores = np.concatenate([scores, got])
            if len(ids) > k:  # all that reach the kth score stay, so that ids can settle ties
                top = scores >= -np.partition(-scores, k - 1)[k - 1]
                ids, scores = ids[top], scores[top]
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            if high == n or not len(dims):
                break
            last = self.sorted[dims, np.where(down, n - high, high - 1)]
            if len(ids) >= k and int(w @ last) < scores.min():
                break
            low, high = high, min(2 * high, n)
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _matrix(vectors, scale: float, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        x = np.floor(scale * np.asarray(v, dtype=np.float64))
        if len(x) and np.abs(x).max() >= 2.0**62:
            raise OverflowError("components of these vectors do not fit in 62 bits")
        out[i, : len(v)] = x
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of ``vectors`` for every different row of ``queries``.

    Both have (vec_id, embedding). Blocks hold about ``block`` and ``query_block`` rows, dealt by a hash of
    the id and the vector, so the work of a task is bounded; the number of tasks grows with both sides.
    """
    base, ask = usable(vectors).select("vec_id", "embedding"), usable(queries).select("vec_id", "embedding")
    n, m = base.count(), ask.count()
    blocks, asks = max(1, -(-n // block)), max(1, -(-m // query_block))
    deal = lambda df, parts: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)).cast("int")
    left = base.withColumn("b", deal(base, blocks)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    ask = ask.distinct().withColumn("ask", F.xxhash64("vec_id", "embedding"))
    right = ask.withColumn("a", deal(ask, asks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(rows, wanted):
        import pandas as pd

        if not len(rows) or not len(wanted):
            return pd.DataFrame({"ask": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(max(map(len, rows["embedding"])), max(map(len, wanted["embedding"])))
        lists = Lists(rows["vec_id"].to_numpy(np.int64), _matrix(rows["embedding"], scale, width))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for ask, own, q in zip(wanted["ask"].to_numpy(np.int64), wanted["vec_id"].to_numpy(np.int64), _matrix(wanted["embedding"], scale, width), strict=True):
            ids, scores = lists.best(q, own, k)
            for c, v in zip(out, (np.full(len(ids), ask), np.full(len(ids), own), ids, scores), strict=True):
                c.append(v)
        return pd.DataFrame(dict(zip(("ask", "query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))

    found = right.groupBy("a", "b").cogroup(left.groupBy("a", "b")).applyInPandas(lambda q, c: search(c, q), "ask long, query_id long, vec_id long, score long")
    w = Window.partitionBy("ask", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir) -> DataFrame:
    """The five best of all other vectors for each vector whose id is divisible by 50."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(e, e.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
           FROM (SELECT DISTINCT vec_id, e FROM v) q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                  vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
