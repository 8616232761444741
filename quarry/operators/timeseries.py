"""Buckets, sessions, rankings, counters and continuous aggregates over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(ts: Column | str, seconds: int) -> Column:
    """The start of the epoch-aligned bucket that holds ``ts``."""
    micros = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    width = F.lit(seconds * 1_000_000)
    return F.timestamp_micros(micros - F.pmod(micros, width))


def bucket_aggregates(df: DataFrame, ts: str, value: str, seconds: int, by: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """avg, min, max, sum, count, first and last of ``value`` per bucket; ``tie`` orders equal times."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(time_bucket(ts, seconds).alias("bucket"), *by).agg(
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(value).alias("sum"),
        F.count(value).alias("count"),
        F.min_by(value, at).alias("first"),
        F.max_by(value, at).alias("last"),
    )


def sessionize(df: DataFrame, actor: str, ts: str, gap_seconds: int, tie: str) -> DataFrame:
    """Adds ``session_start``: a session ends where the next event is strictly more than the gap later.

    An event without a time never starts a session, and the event after it joins the session it is in.
    """
    w = Window.partitionBy(actor).orderBy(F.col(ts).asc_nulls_last(), tie)
    before = F.lag(ts).over(w)
    first = F.row_number().over(w) == 1
    new = first | (F.unix_micros(ts) - F.unix_micros(before) > gap_seconds * 1_000_000)
    marked = df.withColumn("_start", F.when(new, F.col(ts)))
    return marked.withColumn("session_start", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def ranking(df: DataFrame, score: str, tie: str, top: int, ascending: bool = False) -> DataFrame:
    """The head of a ranking: the ``top`` rows by score, with ``rank``. The limit comes before the window."""
    order = [F.col(score).asc() if ascending else F.col(score).desc(), F.col(tie).asc()]
    head = df.orderBy(*order).limit(top)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rank_of(df: DataFrame, score: str, tie: str, key: int) -> DataFrame:
    """The exact rank of one row: how many come before it, by an aggregate without a sort. No row where ``key`` is not there."""
    mine = df.where(F.col(tie) == key).select(F.col(score).alias("_s"), F.col(tie).alias("_k")).limit(1)
    ahead = (F.col(score) > F.col("_s")) | ((F.col(score) == F.col("_s")) & (F.col(tie) < F.col("_k")))
    return df.crossJoin(F.broadcast(mine)).groupBy("_k").agg((F.count_if(ahead) + 1).alias("rank")).select("rank")


def approx_rank_of(df: DataFrame, score: str, value: float, steps: int = 100) -> DataFrame:
    """About the share of rows above ``value``, from a sketch of ``steps`` quantiles."""
    q = df.agg(F.percentile_approx(score, [i / steps for i in range(steps + 1)], 10_000).alias("q"), F.count("*").alias("n"))
    above = F.size(F.filter("q", lambda x: x > value)) / (steps + 1)
    return q.select(F.round(above * F.col("n")).cast("long").alias("approx_rank"), "n")


def increases(df: DataFrame, series: list[str], ts: str, value: str, chunk_seconds: int = 86_400) -> DataFrame:
    """Adds ``delta`` and ``seconds`` since the sample before in its series; a counter that falls was reset to zero.

    Samples are ordered within a series and chunk of time; a chunk's first sample follows the last one of the chunk before it
    that has any. A busy series is as many tasks as it has chunks. Samples without a time take no part.
    """
    rows = df.where(F.col(ts).isNotNull()).withColumn("_chunk", F.floor(F.unix_seconds(ts) / chunk_seconds))
    w = Window.partitionBy(*series, "_chunk").orderBy(ts)
    own = F.struct(F.col(value).alias("v"), F.col(ts).alias("t"))
    last = rows.groupBy(*series, "_chunk").agg(F.max_by(own, ts).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*series).orderBy("_chunk"))).drop("_last")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*series, "_chunk"]]
    joined = rows.withColumn("_own", F.lag(own).over(w)).alias("r").join(carried.alias("c"), same, "left")
    joined = joined.select(*[f"r.{c}" for c in df.columns], F.coalesce("_own", "_carried").alias("_b"))
    before = F.col("_b.v")
    delta = F.when(F.col(value) >= before, F.col(value) - before).when(before.isNotNull(), F.col(value))
    return joined.withColumn("delta", delta).withColumn("seconds", (F.unix_micros(ts) - F.unix_micros("_b.t")) / 1e6).drop("_b")


def rate(df: DataFrame, series: list[str], ts: str, value: str, window_seconds: int) -> DataFrame:
    """``increase`` and ``rate`` per series and window of fixed length."""
    steps = increases(df, series, ts, value)
    per = steps.groupBy(*series, time_bucket(ts, window_seconds).alias("bucket")).agg(F.sum("delta").alias("increase"))
    return per.withColumn("rate", F.col("increase") / window_seconds)


def histogram_quantile(buckets: DataFrame, by: list[str], le: str, count: str, q: float) -> DataFrame:
    """Linear interpolation in cumulative buckets; the last (infinite) bucket gives the bound below it."""
    w = Window.partitionBy(*by)
    total = F.max(count).over(w)
    rows = buckets.select(*by, le, count, total.alias("_n"), F.lag(count, 1, 0).over(w.orderBy(le)).alias("_c"), F.lag(le, 1, 0.0).over(w.orderBy(le)).alias("_low"))
    rank = F.lit(q) * F.col("_n")
    hit = rows.where((F.col(count) >= rank) & ((F.col("_c") < rank) | (F.col("_c") == 0)))
    inside = F.col("_low") + (F.col(le) - F.col("_low")) * (rank - F.col("_c")) / (F.col(count) - F.col("_c"))
    value = F.when(F.col(le) == float("inf"), F.col("_low")).otherwise(inside)
    return hit.groupBy(*by).agg(F.min(value).alias("quantile"))


def refresh_aggregate(df: DataFrame, ts: str, value: str, seconds: int, last: str, now: str, lag_seconds: int) -> DataFrame:
    """One refresh of a continuous aggregate: the whole buckets in [last, now - lag), rounded down; later runs never reread them."""
    until = time_bucket(F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {lag_seconds} SECONDS"), seconds)
    new = df.where((F.col(ts) >= F.to_timestamp(F.lit(last))) & (F.col(ts) < until))
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return new.groupBy(time_bucket(ts, seconds).alias("bucket")).agg(F.avg(finite).alias("avg"), F.count(finite).alias("n"))


class ContinuousAggregate:
    """Sums and counts per bucket, kept in a folder with the time up to which they were taken.

    Each ``refresh`` reads the rows from that time to ``now - lag``, rounded down to whole buckets and at most ``max_interval`` further,
    appends their buckets and then moves the time: a refresh that fails is simply repeated. Rows that come later
    than their bucket's refresh are not seen. Times are seconds since 1970.
    """

    def __init__(self, spark, folder: str, ts: str, value: str, seconds: int, lag: int, start: int, max_interval: int | None = None) -> None:
        self.spark, self.folder, self.ts, self.value, self.seconds = spark, folder.rstrip("/"), ts, value, seconds
        self.lag, self.start, self.max_interval = lag, start, max_interval

    def upto(self) -> int:
        """The stored time: that of the latest folder of buckets that was written whole."""
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return self.start
        done = [f.getPath().getName() for f in fs.listStatus(base) if fs.exists(f.getPath().suffix("/_SUCCESS"))]
        return max([int(n.split("=")[1]) for n in done], default=self.start)

    def refresh(self, df: DataFrame, now: int) -> int:
        """Takes in what is due; returns the new time. ``upto`` names the folder, so a repeated refresh replaces its own."""
        at, floor = self.upto(), lambda t: t - t % self.seconds
        until = floor(now - self.lag)
        if self.max_interval is not None:
            until = min(until, floor(at + self.max_interval))
        if until <= at:
            return at
        t = F.unix_micros(self.ts)
        finite = F.when(~F.isnan(self.value) & (F.abs(self.value) != float("inf")), F.col(self.value))
        due = df.where((t >= at * 1_000_000) & (t < until * 1_000_000))
        out = due.groupBy(time_bucket(self.ts, self.seconds).alias("bucket")).agg(F.sum(finite).alias("sum"), F.count(finite).alias("n"))
        out.write.mode("overwrite").parquet(f"{self.folder}/upto={until}")
        return until

    def read(self) -> DataFrame:
        """All buckets so far, merged."""
        kept = self.spark.read.schema("bucket timestamp, sum double, n long, upto long").option("basePath", self.folder).parquet(self.folder)
        return kept.groupBy("bucket").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).withColumn("avg", F.try_divide("sum", "n"))


def select_series(df: DataFrame, matchers: list[tuple[str, str, str]]) -> DataFrame:
    """Samples whose labels match: (label, = | != | =~ | !~, text); patterns are of the whole text, a missing label is empty."""
    for label, op, text in matchers:
        v = F.coalesce(F.col(label).cast("string"), F.lit(""))
        hit = v == text if op in ("=", "!=") else v.rlike(f"^(?:{text})$")
        df = df.where(~hit if op.startswith("!") else hit)
    return df


def combine_series(a: DataFrame, b: DataFrame, on: list[str], value: str, op: str) -> DataFrame:
    """``a op b`` of the samples with equal ``on`` (labels and time); others drop out. Division by zero is null."""
    both = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on)
    x, y = F.col("_a"), F.col("_b")
    return both.select(*on, {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op].alias(value))


def series_budget(df: DataFrame, labels: list[str], most: int) -> DataFrame:
    """How many series there are and whether that is within the budget."""
    n = F.count_distinct(*labels)
    return df.agg(n.alias("series"), (n <= most).alias("within"))
