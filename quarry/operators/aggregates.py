"""Aggregates beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, by: list[str], column: str, quantiles: dict[str, float], ranges: int = 256) -> DataFrame:
    """Exact nearest-rank quantiles of a number: the value at round(p * (n - 1)) in order, never interpolated.

    Equal values are counted first. Their counts are added up per range of values (``ranges`` between a group's least and greatest), the
    small table of ranges tells in which one each rank falls, and only that range's values are sorted: no window holds a group.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    v = F.col(column).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    ends = counts.groupBy(*by).agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"), F.sum("_n").alias("_all"))
    on = lambda a, b: a.join(b, by) if by else a.crossJoin(F.broadcast(b))
    share = (finite - F.col("_low")) / (F.col("_high") - F.col("_low"))
    part = F.when(F.isnan(v), ranges + 1).when(v == float("inf"), ranges).when(v == float("-inf"), -1)  # in the order of values
    part = part.when(F.col("_high") > F.col("_low"), F.least(F.floor(share * ranges), F.lit(ranges - 1))).otherwise(0)
    placed = on(counts, ends).withColumn("_part", part.cast("int"))
    sums = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"), F.first("_all").alias("_all"))
    w = Window.partitionBy(*by).orderBy("_part")
    upto = sums.withColumn("_before", F.sum("_in").over(w) - F.col("_in"))
    asked = F.array(*[F.struct(F.lit(name).alias("q"), F.round(F.lit(p) * (F.col("_all") - 1)).cast("long").alias("i")) for name, p in quantiles.items()])
    hit = upto.select(*by, "_part", "_before", "_in", F.inline(asked)).where("i >= _before AND i < _before + _in")
    mine = placed.select(*by, "_part", column, "_n").join(hit, [*by, "_part"])
    seen = Window.partitionBy(*by, "_part", "q").orderBy(column)
    ranked = mine.withColumn("_to", F.col("_before") + F.sum("_n").over(seen)).where("i >= _to - _n AND i < _to")
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("q") == name, F.col(column))).alias(name) for name in quantiles])


def group_array(df: DataFrame, by: list[str], column: str, n: int, order: str, name: str) -> DataFrame:
    """The first ``n`` values of each group in ``order``, gathered after ranking so that groups stay small."""
    w = Window.partitionBy(*by).orderBy(order)
    head = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return head.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", column))), lambda s: s[column]).alias(name))


def roll_up(pre: DataFrame, by: list[str], measures: dict[str, str]) -> DataFrame:
    """A coarser grouping from an existing pre-aggregate: counts and sums add, extremes combine."""
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    return pre.groupBy(*by).agg(*[how[f](c).alias(c) for c, f in measures.items()])


def from_stored(df: DataFrame, stored: list[tuple[DataFrame, list[str], dict[str, tuple[str, str]]]], by: list[str], measures: dict[str, tuple[str, str | None]]) -> DataFrame:
    """``by`` and ``measures`` (name -> (count | sum | min | max, column)) from the first stored pre-aggregate that covers them, else from ``df``.

    ``stored``: (rows, their grouping columns, column -> what it holds as (function, column)). It covers a query whose grouping columns
    are among its own and each of whose measures it holds.
    """
    how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    for pre, keys, held in stored:
        at = {v: k for k, v in held.items()}
        if set(by) <= set(keys) and all(m in at for m in measures.values()):
            return pre.groupBy(*by).agg(*[how[f](at[f, c]).alias(name) for name, (f, c) in measures.items()])
    plain = {"count": lambda c: F.count("*" if c is None else c), "sum": F.sum, "min": F.min, "max": F.max}
    return df.groupBy(*by).agg(*[plain[f](c).alias(name) for name, (f, c) in measures.items()])
