"""Queries across models: rows with graphs, paths and searches, triples, walks, keys and values, streams, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph, search, versions
from quarry.plans.graphs import _EDGES, trade
from quarry.plans.searches import _BM, _COS, _LEN, _Q, _SC, _WORDS, _bm, _long, _queries
from quarry.plans.sqlviews import adder
from quarry.registry import Registry
from quarry.session import table
from quarry.sources import files

R = Registry()
sql = adder(R)


def _first(spark, sf):
    return trade(spark, sf).agg(F.min("src").alias("node"))


# rows joined with graphs, paths and searches
R.add("join_graph", f"WITH {_EDGES} SELECT c_custkey, dst, n FROM customer JOIN e ON c_nationkey = src WHERE c_acctbal > 9000")(
    lambda spark, sf: table(spark, sf, "customer").where("c_acctbal > 9000").join(trade(spark, sf), F.col("c_nationkey") == F.col("src")).select("c_custkey", "dst", "n")
)
_REACH = f"{_EDGES}, t(node, depth) AS (SELECT (SELECT MIN(src) FROM e), 0 UNION SELECT dst, depth + 1 FROM t JOIN e ON src = node WHERE depth < 3), m AS (SELECT node, MIN(depth) AS depth FROM t GROUP BY node)"
R.add("join_path", f"WITH RECURSIVE {_REACH} SELECT s_suppkey, depth FROM supplier JOIN m ON s_nationkey = node")(
    lambda spark, sf: table(spark, sf, "supplier").join(graph.neighborhood(trade(spark, sf), _first(spark, sf), 3), F.col("s_nationkey") == F.col("node")).select("s_suppkey", "depth")
)
R.add("join_hybrid", f"WITH {_BM}, ln AS ({_LEN}), hy AS (SELECT doc_id, 0.7 * COALESCE(x.s, 0) + 0.3 * COALESCE(y.s, 0) AS score FROM {_SC.format('bm')} x FULL JOIN {_SC.format('ln')} y USING (doc_id)) SELECT doc_id, quality, ROUND(score, 8) AS score FROM hy JOIN labels USING (doc_id)")(
    lambda spark, sf: search.fuse_linear(_bm(spark, sf), _long(spark, sf), "doc_id", 0.7)
    .join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    .select("doc_id", "quality", F.round("score", 8).alias("score"))
)
R.add(
    "graph_expand",
    f"""WITH RECURSIVE {_EDGES}, t(s, node, d) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0 FROM nation WHERE n_regionkey = 1 UNION SELECT s, dst, d + 1 FROM t JOIN e ON src = node WHERE d < 2)
    SELECT n_name, node AS related, MIN(d) AS hops FROM t JOIN nation ON s = n_nationkey GROUP BY 1, 2""",
)(
    lambda spark, sf: graph.expand(trade(spark, sf), table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("k"), "n_name"), "k", 2).select("n_name", "related", "hops")
)

# paths, communities and walks
_PATHS = f"""{_EDGES}, x AS (SELECT src, dst, n FROM e WHERE src <> dst),
    t(node, hops, path, cost) AS (SELECT MIN(src), 0, [MIN(src)], CAST(0 AS BIGINT) FROM e
    UNION ALL SELECT dst, hops + 1, list_append(path, dst), CAST(cost + n AS BIGINT) FROM t JOIN x ON src = node WHERE hops < 3 AND NOT list_contains(path, dst))"""


def _weighted(spark, sf):
    return trade(spark, sf).withColumnRenamed("n", "weight")


R.add("graph_simple_paths", f"WITH RECURSIVE {_PATHS} SELECT node, hops, path, cost FROM t WHERE hops > 0")(
    lambda spark, sf: graph.simple_paths(_weighted(spark, sf), _first(spark, sf), 3).select("node", "hops", "path", "cost")
)
R.add("graph_k_shortest", f"WITH RECURSIVE {_PATHS} SELECT node, path, cost, CAST(row_number() OVER (PARTITION BY node ORDER BY cost, hops, path) AS INTEGER) AS rank FROM t WHERE hops > 0 QUALIFY rank <= 3")(
    lambda spark, sf: graph.k_shortest(_weighted(spark, sf), _first(spark, sf), 3, 3).select("node", "path", "cost", "rank")
)
R.add("graph_louvain")(lambda spark, sf: graph.louvain(trade(spark, sf)))
R.add(
    "graph_walk",
    f"WITH {_EDGES}, a AS (SELECT y.dst AS node, COUNT(*) AS n FROM e x JOIN e y ON x.dst = y.src GROUP BY 1) SELECT z.src AS node, CAST(SUM(a.n) AS BIGINT) AS n FROM a JOIN e z ON z.dst = a.node GROUP BY 1",
)(lambda spark, sf: graph.walk(trade(spark, sf), trade(spark, sf).select(F.col("src").alias("node")).distinct(), ["out", "out", "in"]))
R.add(
    "graph_walk_dedup",
    f"WITH {_EDGES}, a AS (SELECT DISTINCT dst AS node FROM e) SELECT node, COUNT(*) AS n FROM (SELECT e.dst AS node FROM a JOIN e ON src = a.node UNION ALL SELECT e.src FROM a JOIN e ON dst = a.node) GROUP BY 1",
)(lambda spark, sf: graph.walk(trade(spark, sf), trade(spark, sf).select(F.col("src").alias("node")).distinct(), ["out", "dedup", "both"]))


def _triples(spark, sf):
    """Customers, nations and regions as (s, p, o) texts."""
    c = table(spark, sf, "customer").selectExpr("concat('c', c_custkey) AS id", "concat('n', c_nationkey) AS a", "c_mktsegment AS b")
    n = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS a", "n_name AS b")
    both = c.selectExpr("id AS s", "stack(2, 'in', a, 'segment', b) AS (p, o)").unionByName(n.selectExpr("id AS s", "stack(2, 'in', a, 'name', b) AS (p, o)"))
    rich = table(spark, sf, "customer").where("c_acctbal > 8000").selectExpr("concat('c', c_custkey) AS s", "'is' AS p", "'rich' AS o")
    return both.unionByName(rich)


R.add(
    "graph_triples",
    "SELECT 'c' || c_custkey AS c, n_name AS name, CASE WHEN c_acctbal > 8000 THEN 'rich' END AS what FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey = 2",
)(
    lambda spark, sf: graph.match_triples(_triples(spark, sf), [("?c", "segment", "BUILDING"), ("?c", "in", "?n"), ("?n", "in", "r2"), ("?n", "name", "?name")], [("?c", "is", "?what")]).select("c", "name", "what")
)

# searches
R.add("vector_quantised", f"WITH {_Q}, d AS (SELECT query_id, vec_id, ROUND({_COS}, 12) AS distance FROM embeddings e, q WHERE vec_id <> query_id) SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10")(
    lambda spark, sf: search.quantised_search(table(spark, sf, "embeddings").select("vec_id", "embedding"), _queries(spark, sf), 10, over=4).select("query_id", "vec_id", "rank")
)
_MERGED = f"WITH {_BM}, q AS (SELECT doc_id, quality FROM labels WHERE quality = 1), s AS (SELECT doc_id, score / (1 + score) AS s FROM bm)"
R.add("hybrid_intersection", f"{_MERGED} SELECT doc_id, ROUND((s + 1) / 2, 8) AS score FROM s JOIN q USING (doc_id)")(
    lambda spark, sf: _unit(spark, sf).join(_good(spark, sf), "doc_id").select("doc_id", F.round((F.col("s") + 1) / 2, 8).alias("score"))
)
R.add("hybrid_union", f"{_MERGED} SELECT doc_id, ROUND(0.4 * (CASE WHEN q.quality IS NULL THEN 0 ELSE 1 END) + 0.6 * COALESCE(s, 0), 8) AS score FROM s FULL JOIN q USING (doc_id)")(
    lambda spark, sf: _unit(spark, sf).join(_good(spark, sf), "doc_id", "full").select("doc_id", F.round(F.lit(0.4) * F.when(F.col("quality").isNull(), 0).otherwise(1) + F.lit(0.6) * F.coalesce("s", F.lit(0.0)), 8).alias("score"))
)


def _unit(spark, sf):
    return _bm(spark, sf).select("doc_id", (F.col("score") / (1 + F.col("score"))).alias("s"))


def _good(spark, sf):
    return table(spark, sf, "labels").where("quality = 1").select("doc_id", "quality")


sql(
    "search_everywhere",
    """SELECT 'customer' AS collection, CAST(c_custkey AS STRING) AS id FROM customer WHERE contains(lower(c_name), '00012')
       UNION ALL SELECT 'supplier', CAST(s_suppkey AS STRING) FROM supplier WHERE contains(lower(s_name), '00012')
       UNION ALL SELECT 'part', CAST(p_partkey AS STRING) FROM part WHERE contains(lower(p_name), '00012')
       UNION ALL SELECT 'documents', CAST(doc_id AS STRING) FROM documents WHERE contains(lower(text), '00012')""",
)
R.add("text_tfidf", f"WITH {_WORDS}, c AS (SELECT doc_id, t AS term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM w) GROUP BY 1, 2), f AS (SELECT term, COUNT(*) AS df FROM c GROUP BY 1) SELECT doc_id, term, ROUND(tf * (ln(((SELECT COUNT(*) FROM documents) + 1.0) / (df + 1.0)) + 1), 8) AS weight FROM c JOIN f USING (term)")(
    lambda spark, sf: search.tfidf(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "term", F.round("weight", 8).alias("weight"))
)

# updates, keys and values, streams
R.add("update_ordered_limit", "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= 20 THEN c_acctbal - 100 ELSE c_acctbal END AS c_acctbal FROM customer")(
    lambda spark, sf: versions.update_first(table(spark, sf, "customer"), "c_custkey", [F.desc("c_acctbal"), F.col("c_custkey")], 20, {"c_acctbal": F.col("c_acctbal") - 100}).select("c_custkey", "c_acctbal")
)
sql(
    "kv_increment",
    "SELECT user_id AS key, SUM(CASE event_type WHEN 'purchase' THEN 10 WHEN 'error' THEN -1 ELSE 1 END) AS value FROM events GROUP BY user_id",
    "SELECT user_id AS key, CAST(SUM(CASE event_type WHEN 'purchase' THEN 10 WHEN 'error' THEN -1 ELSE 1 END) AS BIGINT) AS value FROM events GROUP BY user_id",
)
R.add("kv_watch", "SELECT user_id, event_id, b AS before, event_type AS after FROM (SELECT *, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE b IS DISTINCT FROM event_type AND CAST(user_id AS VARCHAR) LIKE '1%' AND event_id > 100")(
    lambda spark, sf: versions.changes(table(spark, sf, "events").where(F.col("user_id").cast("string").startswith("1")), "user_id", ["ts", "event_id"], "event_type").where("event_id > 100").select("user_id", "event_id", "before", F.col("event_type").alias("after"))
)
sql("stream_read_since", "SELECT event_id, event_type FROM events WHERE event_id > 250 ORDER BY event_id LIMIT 100")
R.add("stream_retention", "SELECT user_id, event_id FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 20 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")(
    lambda spark, sf: versions.retain(table(spark, sf, "events"), "user_id", "ts", "event_id", 5, 20 * 86_400).select("user_id", "event_id")
)

# metrics, metadata, partitions, samples, JSON
sql(
    "metric_avg_without",
    "SELECT CAST(unix_seconds(ts) DIV 86400 * 86400 AS BIGINT) AS bucket, event_type, round(avg(total), 6) AS value FROM (SELECT ts, event_type, user_id, SUM(value) AS total FROM (SELECT date_trunc('DAY', ts) AS ts, event_type, user_id, value FROM events) GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "SELECT CAST(epoch(ts) AS BIGINT) AS bucket, event_type, round(avg(total), 6) AS value FROM (SELECT date_trunc('day', ts) AS ts, event_type, user_id, SUM(value) AS total FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
sql(
    "filter_csv_member",
    "SELECT p_partkey FROM part WHERE array_contains(split(concat_ws(',', p_brand, p_type), ','), 'PROMO')",
    "SELECT p_partkey FROM part WHERE list_contains(string_split(concat_ws(',', p_brand, p_type), ','), 'PROMO')",
)
R.add("source_partitioned", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")(
    lambda spark, sf: spark.read.parquet(files.write(table(spark, sf, "orders"), "parquet", ["o_orderstatus"])).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice")
)
sql("show_sample", "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5")
sql("inline_rows", "SELECT n_name, w FROM nation JOIN (VALUES (0, 'a'), (2, 'b')) AS v(r, w) ON n_regionkey = r")
sql(
    "json_extract",
    "SELECT event_id, get_json_object(concat('{\"a\":', props, ',\"t\":[\"x\",\"', event_type, '\"]}'), '$.a.k') AS k, get_json_object(concat('{\"a\":', props, ',\"t\":[\"x\",\"', event_type, '\"]}'), '$.t[1]') AS t FROM events",
    "SELECT event_id, json_extract_string(j, '$.a.k') AS k, json_extract_string(j, '$.t[1]') AS t FROM (SELECT event_id, '{\"a\":' || props || ',\"t\":[\"x\",\"' || event_type || '\"]}' AS j FROM events)",
)
sql(
    "json_set",
    "SELECT event_id, to_json(map_concat(map_filter(from_json(props, 'map<string,bigint>'), (k, v) -> k <> 'v'), map('v', event_id))) AS j FROM events",
    "SELECT event_id, CAST(json_merge_patch(props, json_object('v', event_id)) AS VARCHAR) AS j FROM events",
)


# a graph of things: customers, orders, parts and suppliers with what joins them
def things(spark, sf):
    """Nodes ``(id, label, key, amount)``; ids are a letter and the key."""
    c = table(spark, sf, "customer").selectExpr("concat('c', c_custkey) AS id", "'customer' AS label", "c_custkey AS key", "c_acctbal AS amount")
    o = table(spark, sf, "orders").selectExpr("concat('o', o_orderkey)", "'order'", "o_orderkey", "o_totalprice")
    p = table(spark, sf, "part").selectExpr("concat('p', p_partkey)", "'part'", "p_partkey", "p_retailprice")
    s = table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey)", "'supplier'", "s_suppkey", "s_acctbal")
    return c.union(o).union(p).union(s)


def relations(spark, sf):
    """Edges ``(src, dst, kind, amount)``."""
    placed = table(spark, sf, "orders").selectExpr("concat('c', o_custkey) AS src", "concat('o', o_orderkey) AS dst", "'placed' AS kind", "o_totalprice AS amount")
    holds = table(spark, sf, "lineitem").selectExpr("concat('o', l_orderkey)", "concat('p', l_partkey)", "'holds'", "l_quantity")
    from_ = table(spark, sf, "lineitem").selectExpr("concat('p', l_partkey)", "concat('s', l_suppkey)", "'from'", "l_quantity").distinct()
    return placed.union(holds).union(from_)


R.add(
    "graph_match_chain",
    """SELECT c_custkey, o_orderkey, p_partkey, l_quantity AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
       WHERE c_acctbal > 8000 AND l_quantity > 40 AND p_retailprice < 1200""",
)(
    lambda spark, sf: graph.match(
        things(spark, sf),
        relations(spark, sf),
        [{"as": "c", "label": "customer", "where": "amount > 8000"}, {"as": "x", "kind": "placed"}, {"as": "o", "label": "order"}, {"as": "y", "kind": "holds", "where": "amount > 40"}, {"as": "p", "label": "part", "where": "amount < 1200"}],
    ).select(F.col("c.key").alias("c_custkey"), F.col("o.key").alias("o_orderkey"), F.col("p.key").alias("p_partkey"), F.col("y.amount").alias("quantity"))
)
R.add(
    "graph_match_back",
    "SELECT p_partkey, COUNT(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 300000 GROUP BY 1",
)(
    lambda spark, sf: graph.match(
        things(spark, sf), relations(spark, sf), [{"as": "p", "label": "part"}, {"as": "e", "kind": "holds", "way": "in"}, {"as": "o", "label": "order", "where": "amount > 300000"}]
    )
    .groupBy(F.col("p.key").alias("p_partkey"))
    .agg(F.count("*").alias("n"))
)
R.add("join_match", "SELECT s_suppkey, COUNT(*) AS n FROM supplier JOIN (SELECT DISTINCT l_partkey, l_suppkey, l_quantity FROM lineitem) ON s_suppkey = l_suppkey JOIN part ON l_partkey = p_partkey WHERE p_retailprice > 910 GROUP BY 1")(
    lambda spark, sf: table(spark, sf, "supplier")
    .join(
        graph.match(things(spark, sf), relations(spark, sf), [{"as": "p", "label": "part", "where": "amount > 910"}, {"as": "e", "kind": "from"}, {"as": "s", "label": "supplier"}]).select(
            F.explode(F.array("p.id", "s.id")).alias("node")  # rows join a match by any of its nodes
        ),
        F.concat(F.lit("s"), "s_suppkey") == F.col("node"),
    )
    .groupBy("s_suppkey")
    .agg(F.count("*").alias("n"))
)
R.add(
    "graph_walk_has",
    "SELECT 'o' || o_orderkey AS node, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 9000 AND o_totalprice BETWEEN 100000 AND 200000 GROUP BY 1",
)(
    lambda spark, sf: graph.has(
        graph.walk(relations(spark, sf).where("kind = 'placed'"), things(spark, sf).where("label = 'customer' AND amount > 9000").selectExpr("id AS node"), ["out"]),
        things(spark, sf),
        "label = 'order' AND amount BETWEEN 100000 AND 200000",
    )
)
R.add("graph_walk_limit", f"WITH {_EDGES}, a AS (SELECT DISTINCT dst AS node FROM e ORDER BY node LIMIT 4) SELECT dst AS node, COUNT(*) AS n FROM a JOIN e ON src = a.node GROUP BY 1")(
    lambda spark, sf: graph.walk(trade(spark, sf), trade(spark, sf).select(F.col("src").alias("node")).distinct(), ["out", "dedup", "limit 4", "out"])
)
R.add(
    "graph_triples_filter",
    "SELECT 'c' || c_custkey AS c, CASE WHEN c_acctbal > 8000 THEN 'rich' END AS what FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND (c_mktsegment LIKE 'B%' OR c_acctbal > 8000) ORDER BY c LIMIT 40",
)(
    lambda spark, sf: graph.match_triples(_triples(spark, sf), [("?c", "segment", "?s"), ("?c", "in", "?n"), ("?n", "in", "r1")], [("?c", "is", "?what")])
    .where("s LIKE 'B%' OR what IS NOT NULL")  # FILTER with BOUND, then LIMIT after OPTIONAL
    .orderBy("c")
    .limit(40)
    .select("c", "what")
)
