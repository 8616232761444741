"""Groups of rows that lie together in sorted partitions, for code that compares rows within small groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def units(rows: DataFrame, key: list[str], spread: str, most: int, worth: str = "n > 1") -> DataFrame:
    """Deal the rows of each key to units of about ``2 * most`` rows such that any two rows meet in one.

    A key of up to ``most`` rows is one unit. A larger one is dealt to parts by a hash of ``spread``, and
    each pair of parts is a unit. Adds ``part, low, high`` (two rows of different parts meet in the unit
    low < high only, two of one part in the unit where low = high too) and leaves out keys that fail
    ``worth``, a condition on the key's number of rows ``n`` and its number of rows with ``home``.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where(worth)
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(most)).cast("int")).drop("n", "homes")
    dealt = rows.join(sizes, key).withColumn("part", F.pmod(F.xxhash64(spread), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    by = [*key, "low", "high"]
    return dealt.drop("other", "parts").repartition(*by).sortWithinPartitions(*by)


def groups(batches: Iterable, key: list[str]) -> Iterator[tuple]:
    """Arrow batches of a partition sorted by ``key`` -> (batch, slices of whole groups of two rows or more)."""
    import pyarrow as pa

    kept = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        kept = t if kept is None else pa.concat_tables([kept, t])
        cut = _edges(kept, key)
        if len(cut) > 2:
            yield kept, [(a, b) for a, b in zip(cut[:-2], cut[1:-1], strict=True) if b - a > 1]
            kept = kept.slice(cut[-2])
    if kept is not None and kept.num_rows > 1:
        yield kept, [(0, kept.num_rows)]


def _edges(t, key: list[str]) -> list[int]:
    n = t.num_rows
    new = np.zeros(n, dtype=bool)
    for k in key:
        c = t[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return [0, *np.flatnonzero(new).tolist(), n] if n else [0]


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix: as many links as join what is joined, no more."""
    n, out = len(near), []
    unseen = np.ones(n, dtype=bool)
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root] = False
        edge = [root]
        while edge:
            x = edge.pop()
            got = np.flatnonzero(near[x] & unseen)
            unseen[got] = False
            out += [(x, y) for y in got.tolist()]
            edge += got.tolist()
    return out
