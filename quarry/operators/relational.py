"""Relational operators that a single SQL clause does not name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import durable


def from_any(collections: dict[str, DataFrame]) -> DataFrame:
    """All collections as one, columns united by name, with ``collection`` saying whence a row comes."""
    parts = [df.withColumn("collection", F.lit(name)) for name, df in collections.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column: values, nulls, distinct values, least and greatest as text. One pass."""
    aggs = []
    for c in df.columns:
        v = F.col(c)
        aggs += [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(v).alias("n"),
                (F.count("*") - F.count(v)).alias("nulls"),
                F.count_distinct(v).alias("ndv"),
                F.min(v).cast("string").alias("low"),
                F.max(v).cast("string").alias("high"),
            )
        ]
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def retain(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """Rows not older than ``interval`` before the newest row."""
    return df.crossJoin(F.broadcast(df.agg(F.max(ts).alias("_newest")))).where(f"{ts} >= _newest - {interval}").drop("_newest")


def within_tenant(df: DataFrame, column: str, tenant: str) -> DataFrame:
    return df.where(F.col(column) == tenant)


def join_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which null keys match each other."""
    return join_in_parts(left, right, key)


def join_in_parts(left: DataFrame, right: DataFrame, key: str, rows: int = 16_384, part: int = 2_016, run: int = 168, small: int = 10_000) -> DataFrame:
    """Inner join on ``key``, null keys matching each other, for keys with many rows on both sides: all columns of both.

    A key's rows are dealt to about ``rows`` of the left by ``part`` of the right a unit, so a busy key is many tasks. Rows travel once per part
    of the other side of their key, those of the right as arrays. A unit's pairs come by runs of ``run`` right rows: each left row unfolds one run,
    then the next run begins. A writer of columns so meets few different values a task, the same run again and again and each left value in
    a stretch: files stay small though the pairs are many (168: a third of the values that Parquet packs under one header, which so keep
    their period). Keys are counted at once, and their counts broadcast if there are no more than ``small``.
    """
    spark = left.sparkSession
    count = lambda d, n: d.groupBy(F.col(key).alias(f"_k{n}")).agg(F.count("*").alias(n))
    a, b = count(left, "_m"), count(right, "_n")
    sizes = durable(a.join(b, a["_k_m"].eqNullSafe(b["_k_n"])).select(F.monotonically_increasing_id().alias("_id"), F.col("_k_m").alias("_k"), "_m", "_n"))
    keys, pairs = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("_m").cast("double") * F.col("_n")), F.lit(0.0))).first()
    # units are dealt by hash: two places for each that is full
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, int(2 * pairs / (rows * part))))
    up = lambda n, most: F.ceil(n / most).cast("int")
    sizes = sizes.select("_id", "_k", "_n", up(F.col("_m"), rows).alias("_rows"), up(F.col("_n"), part).alias("_parts")).withColumn("_runs", up(F.col("_n") / F.col("_parts"), run))
    sizes = F.broadcast(sizes) if keys <= small else sizes
    place = lambda d, n: F.pmod(F.xxhash64(*[d[c] for c in d.columns]), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    x = left.join(sizes, left[key].eqNullSafe(sizes["_k"])).select(*[left[c] for c in left.columns], "_id", place(left, "_rows").alias("_a"), F.explode(upto("_parts")).alias("_b"), "_runs")
    y = right.join(sizes, right[key].eqNullSafe(sizes["_k"])).select("_id", "_rows", "_runs", place(right, "_parts").alias("_b"), F.struct(*[right[c] for c in right.columns]).alias("_v"))
    y = y.groupBy("_id", "_b", "_rows", "_runs").agg(F.collect_list("_v").alias("_v"))
    # one column beside a key that equals its like to the bit: an array of bare values, nulls too, so that no struct is made a pair
    kinds = [dict(d.dtypes)[key] for d in (left, right)]
    own = [c for c in right.columns if c != key] if len(right.columns) == 2 and kinds[0] == kinds[1] and kinds[0] in ("tinyint", "smallint", "int", "bigint", "date") else []
    if own:
        y = y.withColumn("_v", F.col("_v").getField(own[0]))
    # the last run has what a part has beyond its share
    y = y.withColumn("_v", F.transform(upto("_runs"), lambda i: F.slice("_v", i * run + 1, F.when(i < F.col("_runs") - 1, run).otherwise(F.size("_v")))))
    y = y.select(F.col("_id").alias("_key"), F.explode(upto("_rows")).alias("_aa"), F.col("_b").alias("_bb"), "_v")
    x = x.repartition(tasks, "_id", "_a", "_b").withColumn("_run", F.explode(upto("_runs"))).sortWithinPartitions("_id", "_a", "_b", "_run")
    x = x.where(F.spark_partition_id() >= 0)  # always true: keeps the optimizer from dropping the sort, and the order of runs, below a join
    met = x.join(y.hint("merge"), (x["_id"] == y["_key"]) & (x["_a"] == y["_aa"]) & (x["_b"] == y["_bb"]))
    one = F.col("_v")[F.col("_run")]
    if own:
        return met.select(*[left[c] for c in left.columns], *[left[key].alias(c) if c == key else F.explode(one).alias(c) for c in right.columns])
    return met.select(*[left[c] for c in left.columns], F.inline(one))


def join_as_of(left: DataFrame, right: DataFrame, by: str, at: str, take: list[str], chunk_seconds: int = 86_400) -> DataFrame:
    """Each left row with the latest right row of its ``by`` not later than ``at`` (a time); nulls where there is none.

    Null keys and null times match nothing; such left rows stay. Both sides go through one window per key and chunk of time, and
    what a chunk needs from before is the last right row of each earlier chunk: no pair of rows is made that does not
    stay, and a busy key is as many tasks as it has chunks. ``right`` has one row per (by, at).
    """
    chunk = F.floor(F.unix_seconds(at) / chunk_seconds).alias("_chunk")
    known = right.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    other = known.select(by, at, chunk, F.struct(*take).alias("_v"), F.lit(0).alias("_left"))
    rows = left.withColumn("_chunk", chunk).withColumn("_left", F.lit(1)).unionByName(other, allowMissingColumns=True)
    last = other.groupBy(by, "_chunk").agg(F.max_by("_v", at).alias("_last"))
    chunks = rows.where(F.col(by).isNotNull()).select(by, "_chunk").distinct().join(last, [by, "_chunk"], "left")
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(by, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy(by, "_chunk").orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left = 1").join(carried, [by, "_chunk"], "left")
    value = F.coalesce("_v", "_carried")
    return found.select(*left.columns, *[F.when(F.col(at).isNotNull(), value.getField(c)).alias(c) for c in take])


def join_range(left: DataFrame, right: DataFrame, low: str, high: str, at: str, width: float) -> DataFrame:
    """Pairs with low <= at < high by buckets of ``width`` (a typical length of the ranges), not by all pairs.

    Numbers of any kind; empty and null ranges match nothing. A range longer than ``width`` has a row per bucket. A crowded bucket is
    a hot key of an ordinary join, which AQE splits.
    """
    cells = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    a = left.where(F.col(low) < F.col(high)).withColumn("_cell", cells)
    b = right.withColumn("_cell", F.floor(F.col(at) / width))
    return a.join(b, "_cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def count_in_range(left: DataFrame, right: DataFrame, low: str, high: str, at: str, width: float) -> DataFrame:
    """``left`` with ``n``: how many rows of ``right`` have low <= at < high, without making the pairs. Null and empty ranges: 0.

    Points are counted per different ``at``; what is below a bound is what lies in earlier cells of ``width`` and earlier in its own cell.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    points = right.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("_x")).agg(F.count("*").alias("_n"))
    some = left.where(F.col(low) < F.col(high))
    bounds = some.select(F.col(low).alias("_x")).union(some.select(F.col(high))).distinct()
    marks = points.select("_x", "_n").unionByName(bounds.withColumn("_n", F.lit(0).cast("long"))).groupBy("_x").agg(F.sum("_n").alias("_n")).withColumn("_cell", cell("_x"))
    cells = marks.groupBy("_cell").agg(F.sum("_n").alias("_all"))
    before = cells.select("_cell", (F.sum("_all").over(Window.orderBy("_cell")) - F.col("_all")).alias("_before"))  # a row per cell
    inside = F.sum("_n").over(Window.partitionBy("_cell").orderBy("_x")) - F.col("_n")
    below = durable(marks.withColumn("_in", inside).join(before, "_cell").select("_x", (F.col("_in") + F.col("_before")).alias("_below")))
    lows, highs = (below.select(F.col("_x").alias(x), F.col("_below").alias(n)) for x, n in (("_lo", "_a"), ("_hi", "_b")))
    met = left.join(lows, left[low] == lows["_lo"], "left").join(highs, left[high] == highs["_hi"], "left")
    n = F.when(F.col(low) < F.col(high), F.col("_b") - F.col("_a")).otherwise(0)
    return met.select(*[left[c] for c in left.columns], n.alias("n"))


def quantified(df: DataFrame, value: str, op: str, sub: DataFrame, column: str, every: bool) -> DataFrame:
    """``df`` with ``holds``: whether ``value op ANY`` (or, with ``every``, ``ALL``) of ``column`` of ``sub``; three-valued as in SQL.

    ``op`` is one of < <= > >= = <>. ANY over no rows is false, ALL is true. One row of figures is broadcast, not ``sub``, but for equality.
    """
    s = sub.agg(F.count("*").alias("_all"), F.count(column).alias("_some"), F.min(column).alias("_min"), F.max(column).alias("_max"))
    rows = df.crossJoin(F.broadcast(s))
    v, least, most = F.col(value), F.col("_min"), F.col("_max")
    if op in ("=", "<>"):
        there = sub.where(F.col(column).isNotNull()).select(F.col(column).alias("_x")).distinct().withColumn("_in", F.lit(True))
        rows = rows.join(there, rows[value] == there["_x"], "left").drop("_x")
        found = F.coalesce(F.col("_in"), F.lit(False))
        differs = (least != most) | (least != v)  # some value of the list is another
        hit = {("=", False): found, ("=", True): ~differs, ("<>", False): differs, ("<>", True): ~found}[op, every]
    else:
        bound = {("<", False): most, ("<=", False): most, (">", False): least, (">=", False): least, ("<", True): least, ("<=", True): least, (">", True): most, (">=", True): most}[op, every]
        hit = {"<": v < bound, "<=": v <= bound, ">": v > bound, ">=": v >= bound}[op]
    nulls = F.col("_all") > F.col("_some")
    unknown = F.lit(None).cast("boolean")
    if every:
        holds = F.when(F.col("_all") == 0, True).when(v.isNull(), unknown).when(F.col("_some") == 0, unknown).when(~hit, False).when(nulls, unknown).otherwise(True)
    else:
        holds = F.when(F.col("_all") == 0, False).when(v.isNull(), unknown).when(F.col("_some") == 0, unknown).when(hit, True).when(nulls, unknown).otherwise(False)
    return rows.withColumn("holds", holds).select(*df.columns, "holds")
