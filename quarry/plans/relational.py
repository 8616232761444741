"""Scans, projections, filters, joins, aggregation, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregates, relational
from quarry.plans.sqlviews import adder, stacked_views
from quarry.registry import Registry
from quarry.session import table

R = Registry()
sql = adder(R)


@R.add(
    "pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty,
           ROUND(SUM(l_extendedprice), 2) AS sum_base,
           ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
           ROUND(AVG(l_quantity), 6) AS avg_qty, COUNT(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
    """,
)
def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count("*").alias("n"),
    )


# scans
sql("scan_all", "SELECT * FROM nation")
sql("scan_pruned_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 1")
sql("scan_point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
sql("scan_bitmap_and_or", "SELECT p_partkey FROM part WHERE p_size = 10 OR (p_size = 20 AND p_brand LIKE '%1%')")
sql("scan_parallel_count", "SELECT COUNT(*) AS n FROM lineitem WHERE l_discount > 0.05")
R.add(
    "scan_from_any",
    """
    SELECT 'customer' AS collection, c_custkey AS rid, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 5000
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000
    UNION ALL SELECT 'part', p_partkey, p_name, NULL FROM part WHERE NULL > 5000
    """,
)(
    lambda spark, sf: relational.from_any(
        {
            "customer": table(spark, sf, "customer").selectExpr("c_custkey AS rid", "c_name AS name", "c_acctbal AS acctbal"),
            "supplier": table(spark, sf, "supplier").selectExpr("s_suppkey AS rid", "s_name AS name", "s_acctbal AS acctbal"),
            "part": table(spark, sf, "part").selectExpr("p_partkey AS rid", "p_name AS name"),
        }
    ).where("acctbal > 5000")
)
R.add(
    "show_stats",
    """
    SELECT 'c_custkey' AS column_name, COUNT(c_custkey) AS n, COUNT(*) - COUNT(c_custkey) AS nulls, COUNT(DISTINCT c_custkey) AS ndv, CAST(MIN(c_custkey) AS VARCHAR) AS low, CAST(MAX(c_custkey) AS VARCHAR) AS high FROM customer
    UNION ALL SELECT 'c_mktsegment', COUNT(c_mktsegment), COUNT(*) - COUNT(c_mktsegment), COUNT(DISTINCT c_mktsegment), MIN(c_mktsegment), MAX(c_mktsegment) FROM customer
    UNION ALL SELECT 'c_nationkey', COUNT(c_nationkey), COUNT(*) - COUNT(c_nationkey), COUNT(DISTINCT c_nationkey), CAST(MIN(c_nationkey) AS VARCHAR), CAST(MAX(c_nationkey) AS VARCHAR) FROM customer
    """,
)(lambda spark, sf: relational.column_stats(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")))

# projections and filters
sql("project_expressions", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_qty, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
sql("derived_table", "SELECT x.k, x.v FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') AS x WHERE x.v > 100000")
sql("filter_compare", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus <> 'P'")
sql("filter_field_field", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey")
sql("filter_expr_expr", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 10 > l_extendedprice / 10")
sql("filter_and_or_not", "SELECT p_partkey FROM part WHERE NOT (p_size < 25 OR p_retailprice > 1500) AND p_type IS NOT NULL")
sql("filter_null", "SELECT l_orderkey, l_linenumber, NULLIF(l_returnflag, 'N') AS flag FROM lineitem WHERE NULLIF(l_returnflag, 'N') IS NULL")
sql("filter_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
sql("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15 AND p_retailprice NOT BETWEEN 1000 AND 1200")
sql("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '_a%'")
sql("filter_starts_ends", "SELECT p_partkey FROM part WHERE p_type LIKE 'S%' OR p_type LIKE '%L'", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S') OR ends_with(p_type, 'L')")
sql("filter_contains", "SELECT doc_id FROM documents WHERE contains(text, 'token')", "SELECT doc_id FROM documents WHERE contains(text, 'token')")
sql("filter_contains_array", "SELECT doc_id FROM documents WHERE array_contains(split(text, ' '), 'the')", "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
sql(
    "filter_contains_json",
    "SELECT event_id FROM events WHERE exists(from_json(concat('[{\"t\":\"', event_type, '\",\"in\":[', event_id % 7, ',', event_id % 11, ']}]'), 'array<struct<t:string,in:array<bigint>>>'), x -> x.t = 'click' AND array_contains(x.in, 3L))",
    "SELECT event_id FROM events WHERE event_type = 'click' AND (event_id % 7 = 3 OR event_id % 11 = 3)",
)
sql("filter_regex", "SELECT doc_id FROM documents WHERE text RLIKE '[0-9]{16}'", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{16}')")
sql("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
sql("cast_values", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR(20)) AS txt FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS txt FROM orders")
sql("scalar_select", "SELECT (SELECT COUNT(*) FROM nation) AS nations, 1 + 2 AS three")
R.add("retention_filter", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")(
    lambda spark, sf: relational.retain(table(spark, sf, "events"), "ts", "INTERVAL 7 DAYS").select("event_id")
)
R.add("within_tenant", "SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id")(
    lambda spark, sf: relational.within_tenant(table(spark, sf, "events"), "event_type", "click").groupBy("user_id").agg(F.count("*").alias("n"))
)

# joins
sql("join_inner", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
sql("join_left", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_right", "SELECT o.o_orderkey, c.c_name FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
sql("join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey * 20")
sql("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
sql("join_left_filter", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 40")
sql("join_chain", "SELECT r_name, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")
sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("join_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
sql("join_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
sql("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
sql("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT AVG(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
for _name, _op, _every, _of in (
    ("subquery_any", ">", False, "p_size = 10"),
    ("subquery_all", ">=", True, "p_size = 10"),
    ("subquery_any_equal", "=", False, "p_size = 10"),
    ("subquery_all_differ", "<>", True, "p_size = 10"),
):
    R.add(_name, f"SELECT p_partkey FROM part WHERE p_retailprice {_op} {'ALL' if _every else 'ANY'} (SELECT p_retailprice FROM part WHERE {_of})")(
        lambda spark, sf, op=_op, every=_every, of=_of: relational.quantified(table(spark, sf, "part"), "p_retailprice", op, table(spark, sf, "part").where(of).select(F.col("p_retailprice").alias("x")), "x", every)
        .where("holds")
        .select("p_partkey")
    )
R.add("subquery_empty", "SELECT p_partkey, p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size = 999) AS some, p_retailprice < ALL (SELECT p_retailprice FROM part WHERE p_size = 999) AS every FROM part")(
    lambda spark, sf: relational.quantified(
        relational.quantified(table(spark, sf, "part"), "p_retailprice", "<", table(spark, sf, "part").where("p_size = 999").selectExpr("p_retailprice AS x"), "x", False).withColumnRenamed("holds", "some"),
        "p_retailprice", "<", table(spark, sf, "part").where("p_size = 999").selectExpr("p_retailprice AS x"), "x", True,
    ).select("p_partkey", "some", F.col("holds").alias("every"))
)
R.add("subquery_all_nulls", "SELECT p_partkey, p_retailprice > ALL (SELECT NULLIF(p_retailprice, 950) FROM part WHERE p_size = 10) AS holds FROM part")(
    lambda spark, sf: relational.quantified(table(spark, sf, "part"), "p_retailprice", ">", table(spark, sf, "part").where("p_size = 10").selectExpr("NULLIF(p_retailprice, 950) AS x"), "x", True).select("p_partkey", "holds")
)
R.add("join_natural", "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, c_nationkey AS k FROM customer) NATURAL JOIN (SELECT s_suppkey, s_nationkey AS k FROM supplier)")(
    lambda spark, sf: relational.join_in_parts(
        table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey AS k").where("k IS NOT NULL"), table(spark, sf, "supplier").selectExpr("s_suppkey", "s_nationkey AS k").where("k IS NOT NULL"), "k"
    ).select("c_custkey", "s_suppkey")
)
R.add(
    "join_null_safe",
    """
    WITH a AS (SELECT c_custkey, NULLIF(c_nationkey % 4, 0) AS k FROM customer), b AS (SELECT s_suppkey, NULLIF(s_nationkey % 4, 0) AS k FROM supplier)
    SELECT c_custkey, s_suppkey FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k
    """,
)(
    lambda spark, sf: relational.join_null_safe(
        table(spark, sf, "customer").selectExpr("c_custkey", "NULLIF(c_nationkey % 4, 0) AS k"), table(spark, sf, "supplier").selectExpr("s_suppkey", "NULLIF(s_nationkey % 4, 0) AS k"), "k"
    ).select("c_custkey", "s_suppkey")
)
R.add(
    "join_as_of",
    """
    SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts
    """,
)(
    lambda spark, sf: relational.join_as_of(
        table(spark, sf, "events").where("event_type = 'click'").select("event_id", "user_id", "ts"),
        table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id")),
        "user_id",
        "ts",
        ["purchase_id"],
    ).select("event_id", "purchase_id")
)


def _within_ten_minutes(events):
    """Per event_id how many events of another id follow within ten minutes; those of its own id are met by an ordinary join and taken off."""
    ten = 600_000_000
    a = events.where("event_id IS NOT NULL").select("event_id", F.unix_micros("ts").alias("low")).withColumn("high", F.col("low") + ten)
    b = events.where("event_id IS NOT NULL").select(F.col("event_id").alias("other"), F.unix_micros("ts").alias("at"))
    every = relational.count_in_range(a, b, "low", "high", "at", ten).groupBy("event_id").agg(F.sum("n").alias("n"))
    own = a.join(b, (F.col("event_id") == F.col("other")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).groupBy("event_id").agg(F.count("*").alias("own"))
    return every.join(own, "event_id").select("event_id", (F.col("n") - F.col("own")).alias("n")).where("n > 0")


R.add(
    "join_range",
    """
    SELECT a.event_id, COUNT(b.event_id) AS n FROM events a JOIN events b
    ON b.ts >= a.ts AND b.ts < a.ts + INTERVAL 10 MINUTE AND b.event_id <> a.event_id GROUP BY a.event_id
    """,
)(
    lambda spark, sf: _within_ten_minutes(table(spark, sf, "events"))
)


# aggregation
sql("agg_group", "SELECT l_returnflag, COUNT(*) AS n, MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem GROUP BY l_returnflag")
sql("agg_implicit_group", "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")
sql("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
sql("agg_counts", "SELECT event_type, COUNT(*) AS n, COUNT(NULLIF(user_id % 3, 0)) AS n_some, COUNT(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
sql("agg_sum_avg", "SELECT l_linestatus, CAST(SUM(l_orderkey) AS BIGINT) AS s, ROUND(AVG(l_discount), 8) AS a FROM lineitem GROUP BY l_linestatus")
sql("agg_expression_key", "SELECT l_quantity > 25 AS big, COUNT(*) AS n FROM lineitem GROUP BY l_quantity > 25")
sql("agg_stddev", "SELECT l_returnflag, ROUND(stddev_pop(l_quantity), 6) AS sd, ROUND(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
sql("agg_string", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_first_last", "SELECT user_id, min_by(event_id, struct(ts, event_id)) AS first_id, max_by(event_id, struct(ts, event_id)) AS last_id FROM events GROUP BY user_id", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id")
sql("agg_covar_corr", "SELECT l_returnflag, ROUND(covar_pop(l_quantity, l_extendedprice), 4) AS cp, ROUND(covar_samp(l_quantity, l_extendedprice), 4) AS cs, ROUND(corr(l_quantity, l_extendedprice), 8) AS c FROM lineitem GROUP BY l_returnflag")
sql("agg_if", "SELECT l_returnflag, CAST(count_if(l_quantity > 30) AS BIGINT) AS n, ROUND(SUM(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS s, ROUND(AVG(CASE WHEN l_tax > 0.04 THEN l_quantity END), 6) AS a FROM lineitem GROUP BY l_returnflag")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_grouping_sets", "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("agg_array_join", "SELECT k, COUNT(*) AS n FROM (SELECT explode(split(p_type, ' ')) AS k FROM part) GROUP BY k", "SELECT k, COUNT(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS k FROM part) GROUP BY k")
R.add(
    "agg_nearest_rank",
    """
    WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT g AS l_returnflag, MAX(CASE WHEN i = round(0.5 * (n - 1)) THEN x END) AS p50, MAX(CASE WHEN i = round(0.9 * (n - 1)) THEN x END) AS p90 FROM r GROUP BY g
    """,
)(lambda spark, sf: aggregates.nearest_rank(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9}))
R.add(
    "agg_group_array",
    "SELECT user_id, list(event_id ORDER BY event_id)[1:3] AS ids FROM events GROUP BY user_id",
)(lambda spark, sf: aggregates.group_array(table(spark, sf, "events"), ["user_id"], "event_id", 3, "event_id", "ids"))
R.add(
    "agg_preaggregate_rewrite",
    "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
)(
    lambda spark, sf: aggregates.roll_up(
        table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s")), ["l_returnflag"], {"n": "sum", "s": "sum"}
    )
)

# sorting and limits; every limit is over a total order
sql("order_multi_key", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 25")
sql("order_expression", "SELECT n_name FROM nation ORDER BY upper(n_name) DESC LIMIT 10")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
sql("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("order_nulls", "SELECT o_orderkey FROM orders ORDER BY NULLIF(o_orderstatus, 'F') ASC NULLS LAST, o_orderkey LIMIT 15")

# set operations
sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("cte", "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT MAX(n) AS m FROM a) SELECT o_custkey FROM a JOIN b ON a.n = b.m")
sql("cte_columns", "WITH a(k, v) AS (SELECT c_custkey, c_acctbal FROM customer) SELECT k FROM a WHERE v < 0")
sql("cte_recursive", "WITH RECURSIVE t(n, s) AS (SELECT 1, CAST(0 AS BIGINT) UNION ALL SELECT n + 1, s + n FROM t WHERE n < 20) SELECT t.n, t.s, nation.n_name FROM t JOIN nation ON nation.n_nationkey = t.n")
R.add("agg_stored_match", "SELECT l_returnflag, COUNT(*) AS n, MAX(l_quantity) AS high FROM lineitem GROUP BY 1")(
    lambda spark, sf: aggregates.from_stored(
        table(spark, sf, "lineitem"),
        [
            (table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("c")), ["l_linestatus"], {"c": ("count", None)}),
            (table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("c"), F.max("l_quantity").alias("m")), ["l_returnflag", "l_linestatus"], {"c": ("count", None), "m": ("max", "l_quantity")}),
        ],
        ["l_returnflag"],
        {"n": ("count", None), "high": ("max", "l_quantity")},
    )
)
sql("view_stacked", "SELECT k, n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') WHERE o_totalprice > 50000 GROUP BY o_custkey) WHERE n > 3")
R.queries["view_stacked"] = lambda spark, sf: stacked_views(spark, {
    "quarry_open": table(spark, sf, "orders").where("o_orderstatus = 'O'"),
    "quarry_large": "SELECT * FROM quarry_open WHERE o_totalprice > 50000",
    "quarry_busy": "SELECT o_custkey AS k, COUNT(*) AS n FROM quarry_large GROUP BY o_custkey",
}, "SELECT k, n FROM quarry_busy WHERE n > 3")
