"""Sources, sinks, the catalog and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.registry import Registry
from quarry.session import shared_dir, table
from quarry.sources import files
from quarry.streaming import runs

R = Registry()

for _kind in ("csv", "json", "orc", "parquet"):
    R.add(f"source_{_kind}", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")(
        lambda spark, sf, kind=_kind: files.round_trip(table(spark, sf, "customer"), kind)
    )
R.add("source_csv_nulls", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS a, CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'x,\"y' END AS b FROM orders")(
    lambda spark, sf: files.round_trip(
        table(spark, sf, "orders").select("o_orderkey", F.expr("NULLIF(o_orderstatus, 'F')").alias("a"), F.expr("CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'x,\"y' END").alias("b")), "csv"
    )
)
R.add("chunked_table", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-01'")(
    lambda spark, sf: files.chunked(table(spark, sf, "orders"), "o_orderdate").where("chunk BETWEEN DATE'1995-03-01' AND DATE'1995-05-01'").select("o_orderkey")
)
_CATALOG = {
    "customer": "c_custkey bigint c_name string c_nationkey int c_acctbal double c_mktsegment string",
    "orders": "o_orderkey bigint o_custkey bigint o_orderstatus string o_totalprice double o_orderdate timestamp o_orderpriority string",
    "events": "event_id bigint ts timestamp user_id bigint event_type string value double props string",
}
_COLUMNS = " UNION ALL ".join(
    f"SELECT '{t}' AS collection, '{c}' AS column_name, '{k}' AS type, {i} AS position, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls FROM {t}"
    for t, of in _CATALOG.items()
    for i, (c, k) in enumerate(zip(of.split()[::2], of.split()[1::2], strict=True))
)
R.add("catalog_columns", _COLUMNS)(lambda spark, sf: files.catalog({t: table(spark, sf, t) for t in _CATALOG}))
R.add("source_csv_options", "SELECT c_custkey, c_name, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer")(
    lambda spark, sf: files.round_trip(table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "NULLIF(c_mktsegment, 'BUILDING') AS segment"), "csv", sep="|", quote="'", nullValue="NA", header="false")
)
R.add("source_partitioned_hash", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")(
    lambda spark, sf: spark.read.parquet(files.write(table(spark, sf, "orders").withColumn("part", F.pmod(F.xxhash64("o_custkey"), F.lit(8))), "parquet", ["part"]))
    .where(F.col("part") == F.pmod(F.xxhash64(F.lit(7).cast("long")), F.lit(8)))
    .where("o_custkey = 7")
    .select("o_orderkey", "o_custkey")
)

_MICROS = "(epoch_us(ts) // 3600000000) * 3600000000"
R.add("stream_windows", f"SELECT {_MICROS} AS start_us, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda spark, sf: runs.over("events", lambda s: runs.windows(s, "ts", "1 hour", ["event_type"], "value"), "update", ["start", "event_type"])(spark, sf).select(
        F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total")
    )
)
R.add("stream_sliding", "SELECT ((epoch_us(ts) // 1800000000) - k) * 1800000000 AS start_us, COUNT(*) AS n FROM events, range(2) AS t(k) GROUP BY 1")(
    lambda spark, sf: runs.over("events", lambda s: runs.windows(s, "ts", "1 hour", [], "value", slide="30 minutes"), "update", ["start"])(spark, sf).select(F.unix_micros("start").alias("start_us"), "n")
)
R.add(
    "stream_sessions",
    """
    WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         t AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s)
    SELECT user_id, epoch_us(MIN(ts)) AS start_us, COUNT(*) AS n FROM t GROUP BY user_id, sid
    """,
)(lambda spark, sf: runs.over("events", lambda s: runs.sessions(s, "ts", "user_id", "1 day"), "complete")(spark, sf).select("user_id", F.unix_micros("start").alias("start_us"), "n"))
R.add("stream_deduplicate", "SELECT DISTINCT user_id, event_type FROM events")(lambda spark, sf: runs.over("events", lambda s: runs.first_seen(s, "ts", ["user_id", "event_type"], "40 days"), "append")(spark, sf))
R.add("stream_append", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")(
    lambda spark, sf: runs.over("events", lambda s: s.where("event_type = 'purchase'").select("event_id", "value"), "append")(spark, sf)
)
R.add("materialized_view", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")(
    lambda spark, sf: files.round_trip(table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), "parquet")
)
# a queue: conversations as messages in order, the first turn of each pending until it is answered
R.add("queue_pending", "SELECT conv_id, MAX(turn) AS turn FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) = 'user'")(
    lambda spark, sf: table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role")).where("role = 'user'").drop("role")
)


def _refreshed(spark, sf):
    """A view of orders per customer, refreshed once over the older orders and once over all."""
    orders = {"now": table(spark, sf, "orders").where("o_orderdate < TIMESTAMP'1996-01-01'")}
    view = files.MaterializedView(spark, f"{shared_dir(spark).rstrip('/')}/view-{uuid.uuid4().hex}", lambda: orders["now"].groupBy("o_custkey").agg(F.count("*").alias("n")))
    view.refresh()
    orders["now"] = table(spark, sf, "orders")
    view.refresh()
    return view.read()


R.add("materialized_view_refresh", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")(_refreshed)
R.add("queue_peek", "SELECT conv_id, turn, role FROM conversations ORDER BY turn, conv_id, role LIMIT 5")(
    lambda spark, sf: table(spark, sf, "conversations").orderBy("turn", "conv_id", "role").select("conv_id", "turn", "role").limit(5)
)
