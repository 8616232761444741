"""Window functions, sessions, rankings, time series and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators import timeseries as ts
from quarry.plans.sqlviews import adder
from quarry.registry import Registry
from quarry.session import shared_dir, table

R = Registry()
sql = adder(R)
_W = "PARTITION BY user_id ORDER BY ts, event_id"

sql("window_row_number", f"SELECT event_id, row_number() OVER ({_W}) AS n FROM events", f"SELECT event_id, CAST(row_number() OVER ({_W}) AS INTEGER) AS n FROM events")
sql("window_rank", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS INTEGER) AS d FROM lineitem")
sql("window_lag_lead", f"SELECT event_id, lag(event_id) OVER ({_W}) AS a, lead(event_id) OVER ({_W}) AS b, lag(event_id, 2, CAST(-1 AS BIGINT)) OVER ({_W}) AS c FROM events")
sql("window_aggregates", "SELECT o_orderkey, COUNT(*) OVER w AS n, MIN(o_totalprice) OVER w AS low, MAX(o_totalprice) OVER w AS high, ROUND(AVG(o_orderkey) OVER w, 6) AS a FROM orders WINDOW w AS (PARTITION BY o_custkey)")
sql("window_range_peers", "SELECT l_orderkey, l_linenumber, SUM(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE UNBOUNDED PRECEDING) AS s FROM lineitem")
sql("window_rows_running", "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
sql("window_rows_trailing", f"SELECT event_id, COUNT(NULLIF(event_type, 'click')) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM events")
sql("window_nulls_order", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY NULLIF(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey) AS INTEGER) AS n FROM orders")
sql("window_extras", f"SELECT event_id, CAST(ntile(4) OVER ({_W}) AS INTEGER) AS q, first_value(event_id) OVER ({_W}) AS f, ROUND(percent_rank() OVER ({_W}), 8) AS p, ROUND(cume_dist() OVER ({_W}), 8) AS c FROM events")

R.add(
    "sessionize",
    """
    WITH s AS (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN ts END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, epoch_us(max(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS session_us FROM s
    """,
)(
    lambda spark, sf: ts.sessionize(table(spark, sf, "events"), "user_id", "ts", 1800, "event_id").select(
        "event_id", "user_id", F.unix_micros("session_start").alias("session_us")
    )
)
R.add(
    "session_summary",
    """
    WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         t AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s)
    SELECT user_id, epoch_us(MIN(ts)) AS start_us, COUNT(*) AS n FROM t GROUP BY user_id, sid
    """,
)(
    lambda spark, sf: table(spark, sf, "events")
    .groupBy("user_id", F.session_window("ts", F.lit("1 day 1 microsecond")).alias("w"))
    .agg(F.count("*").alias("n"))
    .select("user_id", F.unix_micros("w.start").alias("start_us"), "n")
)
R.add("ranking_head", "SELECT c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank <= 20")(
    lambda spark, sf: ts.ranking(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 20)
)
R.add("ranking_range", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank BETWEEN 5 AND 9")(
    lambda spark, sf: ts.ranking(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 9).where("rank >= 5").select("c_custkey", "rank")
)
R.add("rank_of", "SELECT COUNT(*) + 1 AS rank FROM customer a, customer b WHERE b.c_custkey = 7 AND (a.c_acctbal > b.c_acctbal OR (a.c_acctbal = b.c_acctbal AND a.c_custkey < b.c_custkey))")(
    lambda spark, sf: ts.rank_of(table(spark, sf, "customer"), "c_acctbal", "c_custkey", 7)
)
R.add("rank_of_unknown", "SELECT COUNT(*) AS rows FROM customer WHERE c_custkey = -5")(lambda spark, sf: ts.rank_of(table(spark, sf, "customer"), "c_acctbal", "c_custkey", -5).agg(F.count("*").alias("rows")))
R.add("approx_rank_of", "SELECT COUNT(*) AS n, true AS close FROM customer")(
    lambda spark, sf: ts.approx_rank_of(table(spark, sf, "customer"), "c_acctbal", 5000.0)
    .crossJoin(F.broadcast(table(spark, sf, "customer").agg(F.count_if(F.col("c_acctbal") > 5000).alias("above"))))
    .select("n", (F.abs(F.col("approx_rank") - F.col("above")) <= 0.02 * F.col("n")).alias("close"))
)

R.add(
    "time_bucket_aggregates",
    """
    SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS bucket_us, event_type, ROUND(AVG(value), 6) AS avg, MIN(value) AS min, MAX(value) AS max, ROUND(SUM(value), 4) AS sum, COUNT(value) AS count,
           arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last
    FROM events GROUP BY 1, 2
    """,
)(
    lambda spark, sf: ts.bucket_aggregates(table(spark, sf, "events"), "ts", "value", 3600, ("event_type",), "event_id")
    .withColumns({"bucket_us": F.unix_micros("bucket"), "avg": F.round("avg", 6), "sum": F.round("sum", 4)})
    .drop("bucket")
)
R.add("downsample", "SELECT (epoch_us(ts) // 86400000000) * 86400000000 AS bucket_us, ROUND(AVG(value), 6) AS avg FROM events GROUP BY 1")(
    lambda spark, sf: table(spark, sf, "events").groupBy(F.unix_micros(ts.time_bucket("ts", 86400)).alias("bucket_us")).agg(F.round(F.avg("value"), 6).alias("avg"))
)
_COUNTER = "SELECT user_id % 5 AS service, ts, event_id, CAST(event_id % 50 AS DOUBLE) AS v FROM events"
R.add(
    "metric_increase",
    f"""
    WITH c AS ({_COUNTER}), d AS (SELECT service, ts, CASE WHEN v >= lag(v) OVER w THEN v - lag(v) OVER w WHEN lag(v) OVER w IS NOT NULL THEN v END AS delta FROM (SELECT service, ts, max(v) AS v FROM c GROUP BY 1, 2) WINDOW w AS (PARTITION BY service ORDER BY ts))
    SELECT service, (epoch_us(ts) // 86400000000) * 86400000000 AS bucket_us, SUM(delta) AS increase, ROUND(SUM(delta) / 86400, 9) AS rate FROM d GROUP BY 1, 2
    """,
)(
    lambda spark, sf: ts.rate(
        table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("service"), "ts").agg(F.max((F.col("event_id") % 50).cast("double")).alias("v")), ["service"], "ts", "v", 86400
    ).select("service", F.unix_micros("bucket").alias("bucket_us"), "increase", F.round("rate", 9).alias("rate"))
)
R.add(
    "metric_irate",
    """
    WITH d AS (SELECT event_type, ts, value, lag(value) OVER w AS b, lag(ts) OVER w AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS n FROM (SELECT event_type, ts, max(value) AS value FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY event_type ORDER BY ts))
    SELECT event_type, ROUND((CASE WHEN value >= b THEN value - b ELSE value END) / ((epoch_us(ts) - epoch_us(t)) / 1e6), 9) AS irate FROM d WHERE n = 1
    """,
)(
    lambda spark, sf: ts.increases(table(spark, sf, "events").groupBy("event_type", "ts").agg(F.max("value").alias("value")), ["event_type"], "ts", "value")
    .groupBy("event_type")
    .agg(F.round(F.max_by(F.col("delta") / F.col("seconds"), "ts"), 9).alias("irate"))
)
R.add(
    "histogram_quantile",
    """
    WITH b(le) AS (VALUES (10.0), (25.0), (50.0), (100.0), (200.0), (1e9)), c AS (SELECT event_type, CAST(le AS DOUBLE) AS le, COUNT(*) FILTER (WHERE value <= le) AS n FROM events, b GROUP BY 1, 2),
         d AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS t, lag(n, 1, 0) OVER w AS c0, lag(le, 1, 0.0) OVER w AS low FROM c WINDOW w AS (PARTITION BY event_type ORDER BY le))
    SELECT event_type, ROUND(MIN(low + (le - low) * (0.5 * t - c0) / (n - c0)), 6) AS quantile FROM d WHERE n >= 0.5 * t AND (c0 < 0.5 * t OR c0 = 0) GROUP BY 1
    """,
)(
    lambda spark, sf: ts.histogram_quantile(
        table(spark, sf, "events")
        .groupBy("event_type")
        .agg(F.array(*[F.struct(F.lit(le).alias("le"), F.count_if(F.col("value") <= le).alias("n")) for le in (10.0, 25.0, 50.0, 100.0, 200.0, 1e9)]).alias("b"))
        .select("event_type", F.inline("b")),
        ["event_type"],
        "le",
        "n",
        0.5,
    ).select("event_type", F.round("quantile", 6).alias("quantile"))
)
R.add(
    "continuous_aggregate",
    """
    SELECT (epoch_us(ts) // 300000000) * 300000000 AS bucket_us, ROUND(AVG(value), 6) AS avg, COUNT(value) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20 11:55:00' GROUP BY 1
    """,
)(
    lambda spark, sf: ts.refresh_aggregate(table(spark, sf, "events"), "ts", "value", 300, "2024-01-02 00:00:00", "2024-01-20 12:00:00", 300).select(
        F.unix_micros("bucket").alias("bucket_us"), F.round("avg", 6).alias("avg"), "n"
    )
)
R.add("series_budget", "SELECT COUNT(*) AS series, COUNT(*) <= 100 AS within FROM (SELECT DISTINCT event_type, user_id FROM events)")(
    lambda spark, sf: ts.series_budget(table(spark, sf, "events"), ["event_type", "user_id"], 100)
)
sql("chunk_listing", "SELECT date_trunc('MONTH', o_orderdate) AS chunk, COUNT(*) AS n FROM orders GROUP BY 1", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS chunk, COUNT(*) AS n FROM orders GROUP BY 1")
sql("chunk_pruned_scan", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-02-01 00:00:00'")


def _continued(spark, sf):
    """Three refreshes, the second of which is held back by its longest interval, and one with nothing to do."""
    events = table(spark, sf, "events")
    start = 1_704_153_600  # 2024-01-02
    kept = ts.ContinuousAggregate(spark, f"{shared_dir(spark).rstrip('/')}/aggregate-{uuid.uuid4().hex}", "ts", "value", 300, 300, start, max_interval=10 * 86_400)
    for now in (start + 5 * 86_400, start + 18 * 86_400, start + 18 * 86_400 + 7_500, start + 18 * 86_400):
        kept.refresh(events, now)
    return kept.read()


R.add(
    "continuous_aggregate_stored",
    "SELECT (epoch_us(ts) // 300000000) * 300000000 AS bucket_us, ROUND(AVG(value), 6) AS avg, COUNT(value) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20 02:00:00' GROUP BY 1",
)(lambda spark, sf: _continued(spark, sf).select(F.unix_micros("bucket").alias("bucket_us"), F.round("avg", 6).alias("avg"), "n"))
R.add("metric_selector", "SELECT event_type, user_id, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events WHERE regexp_full_match(event_type, 'c.*|view') AND event_type <> 'view' AND user_id <> 3 GROUP BY 1, 2")(
    lambda spark, sf: ts.select_series(table(spark, sf, "events"), [("event_type", "=~", "c.*|view"), ("event_type", "!=", "view"), ("user_id", "!~", "3")])
    .groupBy("event_type", "user_id")
    .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
)


def _daily(spark, sf, kind):
    e = ts.select_series(table(spark, sf, "events"), [("event_type", "=", kind)])
    return e.groupBy(F.unix_micros(ts.time_bucket("ts", 86400)).alias("bucket_us")).agg(F.count("*").cast("double").alias("v"))


_DAILY = "SELECT (epoch_us(ts) // 86400000000) * 86400000000 AS bucket_us, CAST(COUNT(*) AS DOUBLE) AS v FROM events WHERE event_type = '{0}' GROUP BY 1"
R.add("metric_ratio", f"SELECT a.bucket_us, ROUND(a.v / b.v, 9) AS v FROM ({_DAILY.format('purchase')}) a JOIN ({_DAILY.format('view')}) b USING (bucket_us)")(
    lambda spark, sf: ts.combine_series(_daily(spark, sf, "purchase"), _daily(spark, sf, "view"), ["bucket_us"], "v", "/").withColumn("v", F.round("v", 9))
)
