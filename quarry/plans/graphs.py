"""Graph queries: nations that trade (customer's to supplier's), and parts ordered together."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators.components import connected_components
from quarry.registry import Registry
from quarry.session import durable, table

R = Registry()
#: Nations as nodes: who orders from whom, where that is more than usual.
_TRADE = """
    SELECT c_nationkey AS src, s_nationkey AS dst, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
"""
_EDGES = f"e AS (SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, n FROM ({_TRADE}) QUALIFY n > AVG(n) OVER ())"
_TOGETHER = "p AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber)"


def trade(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = li.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("n"))
    e = durable(e)  # a row per pair of nations, made once
    return e.crossJoin(F.broadcast(e.agg(F.avg("n").alias("usual")))).where("n > usual").drop("usual")


def together(spark, sf):
    a = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber + 1 AS l_linenumber", "l_partkey AS src")
    b = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS dst")
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


R.add(
    "graph_match",
    "SELECT r_name, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000",
)(
    lambda spark, sf: table(spark, sf, "region")
    .join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    .join(table(spark, sf, "customer").where("c_acctbal > 9000"), F.col("c_nationkey") == F.col("n_nationkey"))
    .select("r_name", "n_name", "c_custkey")
)
R.add("graph_degree", f"WITH {_EDGES}, x AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, CAST(SUM(i) AS BIGINT) AS in_degree, CAST(SUM(o) AS BIGINT) AS out_degree, COUNT(*) AS degree FROM x GROUP BY node")(
    lambda spark, sf: graph.degree_centrality(trade(spark, sf))
)
R.add(
    "graph_neighborhood",
    f"WITH RECURSIVE {_EDGES}, t(node, depth) AS (SELECT (SELECT MIN(src) FROM e), 0 UNION SELECT dst, depth + 1 FROM t JOIN e ON src = node WHERE depth < 2) SELECT node, MIN(depth) AS depth FROM t GROUP BY node",
)(lambda spark, sf: graph.neighborhood(trade(spark, sf), trade(spark, sf).agg(F.min("src").alias("node")), 2))
R.add(
    "graph_shortest_path",
    f"""WITH RECURSIVE {_EDGES}, t(node, distance) AS (SELECT (SELECT MIN(src) FROM e), 0 UNION SELECT dst, distance + 1 FROM t JOIN e ON src = node WHERE distance < 25)
    SELECT node, CAST(MIN(distance) AS DOUBLE) AS distance FROM t GROUP BY node""",
)(lambda spark, sf: graph.shortest_paths(trade(spark, sf).withColumn("weight", F.lit(1.0)), trade(spark, sf).agg(F.min("src")).first()[0]).select("node", "distance"))
def _rounds(first: str, step: str, n: int, name: str = "r") -> str:
    """CTEs r0 to rn: ``first``, then ``step`` from the one before (``{0}``)."""
    return ", ".join([f"{name}0 AS MATERIALIZED ({first})"] + [f"{name}{i} AS MATERIALIZED ({step.format(f'{name}{i - 1}')})" for i in range(1, n + 1)])


_RELAX = _rounds("SELECT MIN(src) AS node, CAST(0 AS DOUBLE) AS d FROM e", "SELECT node, MIN(d) AS d FROM (SELECT node, d FROM {0} UNION ALL SELECT dst, d + 1.0 / n FROM {0} JOIN e ON src = node) GROUP BY node", 25)
R.add("graph_weighted_paths", f"WITH {_EDGES}, {_RELAX} SELECT node, ROUND(d, 9) AS distance FROM r25")(
    lambda spark, sf: graph.shortest_paths(trade(spark, sf).withColumn("weight", 1.0 / F.col("n")), _first(spark, sf)).select("node", F.round("distance", 9).alias("distance"))
)


def _first(spark, sf):
    return trade(spark, sf).agg(F.min("src")).first()[0]


def _last(spark, sf):
    return trade(spark, sf).agg(F.max("dst")).first()[0]


_HOPS = f"{_EDGES}, t(node, d) AS (SELECT (SELECT MIN(src) FROM e), 0 UNION SELECT dst, d + 1 FROM t JOIN e ON src = node WHERE d < 25)"
R.add(
    "graph_path_rows",
    f"""WITH RECURSIVE {_EDGES}, t(node, path) AS (SELECT MIN(src), [MIN(src)] FROM e UNION ALL SELECT dst, list_append(path, dst) FROM t JOIN e ON src = node WHERE NOT list_contains(path, dst) AND len(path) < 5),
    b AS (SELECT path FROM t WHERE node = (SELECT MAX(dst) FROM e) ORDER BY len(path), path LIMIT 1) SELECT CAST(i AS INTEGER) AS step, path[i + 1] AS node FROM b, unnest(range(0, len(path))) AS u(i)""",
)(lambda spark, sf: graph.path_rows(graph.shortest_paths(trade(spark, sf).withColumn("weight", F.lit(1.0)), _first(spark, sf), _last(spark, sf))))
R.add(
    "graph_all_shortest",
    f"""WITH RECURSIVE {_EDGES}, t(node, path) AS (SELECT MIN(src), [MIN(src)] FROM e UNION ALL SELECT dst, list_append(path, dst) FROM t JOIN e ON src = node WHERE NOT list_contains(path, dst) AND len(path) < 5),
    b AS (SELECT path FROM t WHERE node = (SELECT MAX(dst) FROM e)) SELECT path, CAST(len(path) - 1 AS INTEGER) AS hops FROM b WHERE len(path) = (SELECT MIN(len(path)) FROM b)""",
)(lambda spark, sf: graph.all_shortest(trade(spark, sf), _first(spark, sf), _last(spark, sf)))
R.add(
    "graph_traverse_bfs",
    f"""WITH RECURSIVE {_EDGES}, t(node, path) AS (SELECT MIN(src), [MIN(src)] FROM e UNION ALL SELECT dst, list_append(path, dst) FROM t JOIN e ON src = node WHERE NOT list_contains(path, dst) AND len(path) < 4)
    SELECT node, CAST(len(path) - 1 AS INTEGER) AS depth, path FROM t QUALIFY row_number() OVER (PARTITION BY node ORDER BY len(path), path) = 1""",
)(lambda spark, sf: graph.traverse(trade(spark, sf), _first(spark, sf), 3))
R.add(
    "graph_neighborhood_in",
    f"WITH RECURSIVE {_EDGES}, x AS (SELECT * FROM e WHERE n % 3 <> 0), t(node, depth) AS (SELECT (SELECT MAX(dst) FROM e), 0 UNION SELECT src, depth + 1 FROM t JOIN x ON dst = node WHERE depth < 3) SELECT node, MIN(depth) AS depth FROM t GROUP BY node",
)(
    lambda spark, sf: graph.neighborhood(
        trade(spark, sf).withColumn("kind", F.when(F.col("n") % 3 == 0, "even").otherwise("odd")), trade(spark, sf).agg(F.max("dst").alias("node")), 3, "in", ["odd"]
    )
)
R.add(
    "graph_components",
    f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), t(node, r) AS (SELECT src, src FROM b UNION SELECT dst, r FROM t JOIN b ON src = node) SELECT node, MIN(r) AS component FROM t GROUP BY node HAVING COUNT(*) > 1",
)(lambda spark, sf: connected_components(trade(spark, sf)))
_LINKS = f"{_TOGETHER}, b AS (SELECT src, dst FROM p WHERE src <> dst UNION SELECT dst, src FROM p WHERE src <> dst)"
_LEAST = _rounds("SELECT DISTINCT src AS node, src AS c FROM b", "SELECT node, MIN(c) AS c FROM (SELECT node, c FROM {0} UNION ALL SELECT b.src, c FROM {0} JOIN b ON b.dst = node) GROUP BY node", 30, "m")
R.add("graph_parts_components", f"WITH {_LINKS}, {_LEAST} SELECT node, c AS component FROM m30")(lambda spark, sf: connected_components(together(spark, sf)))
R.add(
    "graph_closeness",
    f"""WITH RECURSIVE {_EDGES}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), t(s, node, d) AS (SELECT node, node, 0 FROM v UNION SELECT s, dst, d + 1 FROM t JOIN e ON src = node WHERE d < 12),
    m AS (SELECT s, node, MIN(d) AS d FROM t GROUP BY 1, 2) SELECT s AS node, ROUND(COALESCE(SUM(1.0 / NULLIF(d, 0)), 0) / GREATEST(1, (SELECT COUNT(*) FROM v) - 1), 8) AS score FROM m GROUP BY s""",
)(lambda spark, sf: graph.closeness(trade(spark, sf)).select("node", F.round("score", 8).alias("score")))
_PAIRS = f"""{_EDGES}, x AS (SELECT src, dst FROM e WHERE src <> dst), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    t(s, node, d) AS (SELECT node, node, 0 FROM v UNION SELECT s, dst, d + 1 FROM t JOIN x ON src = node WHERE d < 24), m AS MATERIALIZED (SELECT s, node, MIN(d) AS d FROM t GROUP BY 1, 2)"""
_WAYS = _rounds("SELECT s, node, d, CAST(1 AS DOUBLE) AS w FROM m WHERE d = 0", "SELECT m.s, m.node, m.d, SUM(y.w) AS w FROM m JOIN x ON x.dst = m.node JOIN {0} y ON y.s = m.s AND y.node = x.src AND y.d + 1 = m.d GROUP BY 1, 2, 3", 12, "y")
R.add(
    "graph_betweenness",
    f"""WITH RECURSIVE {_PAIRS}, {_WAYS}, z AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM y{i}" for i in range(13))}),
    b AS (SELECT i.node, SUM(i.w * o.w / a.w) AS q FROM z i JOIN z o ON o.s = i.node AND o.node <> i.node JOIN z a ON a.s = i.s AND a.node = o.node AND a.d = i.d + o.d WHERE i.s <> i.node GROUP BY 1)
    SELECT v.node, ROUND(COALESCE(q, 0) / GREATEST(1, ((SELECT COUNT(*) FROM v) - 1) * ((SELECT COUNT(*) FROM v) - 2)), 9) AS score FROM v LEFT JOIN b USING (node)""",
)(lambda spark, sf: graph.betweenness(trade(spark, sf)).select("node", F.round("score", 9).alias("score")))


def _rank_sql(edges: str, restart: str, rounds: int) -> str:
    """PageRank by ``rounds`` rounds: far more than it takes to settle to the digits that are compared."""
    step = """SELECT v.node, v.z, v.z * (0.15 + 0.85 * (SELECT COALESCE(SUM(s), 0) FROM {0} WHERE node NOT IN (SELECT src FROM g))) + 0.85 * COALESCE(i.got, 0) AS s
        FROM {0} v LEFT JOIN (SELECT g.dst, SUM(r.s / o.n) AS got FROM g JOIN o USING (src) JOIN {0} r ON r.node = g.src GROUP BY 1) i ON i.dst = v.node"""
    return f"""{edges}, o AS MATERIALIZED (SELECT src, COUNT(*) AS n FROM g GROUP BY 1), v AS (SELECT src AS node FROM g UNION SELECT dst FROM g), k AS MATERIALIZED ({restart}),
    {_rounds("SELECT node, z, z AS s FROM k", step, rounds, "r")} SELECT node, ROUND(s, 8) AS score FROM r{rounds}"""


_EVEN = "SELECT node, 1.0::DOUBLE / (SELECT COUNT(*) FROM v) AS z FROM v"
_SOME = "SELECT node, CASE WHEN node IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 1.0::DOUBLE / (SELECT COUNT(*) FROM v WHERE node IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) ELSE 0 END AS z FROM v"
R.add("graph_pagerank", f"WITH {_TOGETHER}, {_rank_sql('g AS (SELECT src, dst FROM p)', _EVEN, 45)}")(lambda spark, sf: graph.pagerank(together(spark, sf), tolerance=1e-11).withColumn("score", F.round("score", 8)))
R.add("graph_personal_pagerank", f"WITH {_EDGES}, {_rank_sql('g AS (SELECT DISTINCT src, dst FROM e)', _SOME, 180)}")(
    lambda spark, sf: graph.pagerank(trade(spark, sf), tolerance=1e-11, rounds=400, seeds=table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("node"))).withColumn("score", F.round("score", 8))
)
_EIGEN = _rounds(
    "SELECT DISTINCT src AS node, CAST(1 AS DOUBLE) AS s FROM b",
    "SELECT node, s / sqrt(SUM(s * s) OVER ()) AS s FROM (SELECT node, SUM(s) AS s FROM (SELECT node, s FROM {0} UNION ALL SELECT b.src, s FROM {0} JOIN b ON b.dst = node) GROUP BY node)",
    90,
    "h",
)
R.add("graph_eigenvector", f"WITH {_LINKS}, {_EIGEN} SELECT node, ROUND(s, 7) AS score FROM h90")(lambda spark, sf: graph.eigenvector(together(spark, sf), tolerance=1e-9).withColumn("score", F.round("score", 7)))
_HUB = _rounds(
    "SELECT node, CAST(1 AS DOUBLE) AS s FROM v",
    "SELECT v.node, COALESCE(q, 0) / sqrt(SUM(q * q) OVER ()) AS s FROM v LEFT JOIN (SELECT p.src AS node, SUM(a) AS q FROM p JOIN (SELECT p.dst, SUM(s) AS a FROM p JOIN {0} r ON r.node = p.src GROUP BY 1) x ON x.dst = p.dst GROUP BY 1) USING (node)",
    60,
    "h",
)
R.add(
    "graph_hits",
    f"WITH {_TOGETHER}, v AS (SELECT src AS node FROM p UNION SELECT dst FROM p), {_HUB}, a AS (SELECT v.node, COALESCE(q, 0) / sqrt(SUM(q * q) OVER ()) AS s FROM v LEFT JOIN (SELECT p.dst AS node, SUM(s) AS q FROM p JOIN h60 ON h60.node = p.src GROUP BY 1) USING (node)) SELECT node, ROUND(h60.s, 7) AS hub, ROUND(a.s, 7) AS authority FROM h60 JOIN a USING (node)",
)(lambda spark, sf: graph.hits(together(spark, sf), tolerance=1e-9).select("node", F.round("hub", 7).alias("hub"), F.round("authority", 7).alias("authority")))
R.add("graph_label_propagation")(lambda spark, sf: graph.label_propagation(together(spark, sf)))
R.add(
    "graph_strong_components",
    f"WITH RECURSIVE {_EDGES}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), t(s, node) AS (SELECT node, node FROM v UNION SELECT s, dst FROM t JOIN e ON src = node) SELECT a.s AS node, MAX(a.node) AS component FROM t a JOIN t b ON a.s = b.node AND a.node = b.s GROUP BY 1",
)(lambda spark, sf: graph.strong_components(trade(spark, sf)))
R.add("graph_strong_parts")(lambda spark, sf: graph.strong_components(together(spark, sf)))
R.add("graph_degree_top", f"WITH {_TOGETHER}, d AS (SELECT node, COUNT(*) AS score FROM (SELECT src AS node FROM p UNION ALL SELECT dst FROM p) GROUP BY 1) SELECT node, score, CAST(row_number() OVER (ORDER BY score DESC, node) AS INTEGER) AS rank FROM d QUALIFY rank <= 100")(
    lambda spark, sf: graph.window_top(graph.degree_centrality(together(spark, sf)).select("node", F.col("degree").alias("score")))
)
_BOTH = f"{_TOGETHER}, b AS (SELECT src, dst FROM p WHERE src <> dst UNION SELECT dst, src FROM p WHERE src <> dst)"
_TRI = "t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM b x JOIN b y ON x.dst = y.src AND x.src < x.dst AND y.src < y.dst JOIN b z ON z.src = x.src AND z.dst = y.dst)"
R.add("graph_triangles", f"WITH {_BOTH}, {_TRI} SELECT a, b, c FROM t")(lambda spark, sf: graph.triangles(together(spark, sf)))
R.add(
    "graph_clustering",
    f"WITH {_BOTH}, {_TRI}, k AS (SELECT src AS node, COUNT(*) AS k FROM b GROUP BY 1), s AS (SELECT node, COUNT(*) AS t FROM (SELECT unnest([a, b, c]) AS node FROM t) GROUP BY 1) SELECT node, ROUND(CASE WHEN k > 1 THEN 2.0 * COALESCE(t, 0) / (k * (k - 1)) ELSE 0 END, 9) AS score FROM k LEFT JOIN s USING (node)",
)(lambda spark, sf: graph.clustering(together(spark, sf)).select("node", F.round("score", 9).alias("score")))
R.add("graph_cycles", f"WITH {_EDGES} SELECT [x.src, x.dst, y.dst] AS path FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst")(
    lambda spark, sf: graph.cycles(trade(spark, sf), 3)
)
_COEFFICIENT = "k AS (SELECT src AS node, COUNT(*) AS k FROM b GROUP BY 1), s AS (SELECT node, COUNT(*) AS t FROM (SELECT unnest([a, b, c]) AS node FROM t) GROUP BY 1)"
R.add("graph_clustering_global", f"WITH {_BOTH}, {_TRI}, {_COEFFICIENT} SELECT ROUND(AVG(CASE WHEN k > 1 THEN 2.0 * COALESCE(t, 0) / (k * (k - 1)) ELSE 0 END), 9) AS coefficient FROM k LEFT JOIN s USING (node)")(
    lambda spark, sf: graph.global_clustering(together(spark, sf)).select(F.round("coefficient", 9).alias("coefficient"))
)
R.add(
    "graph_properties",
    f"""WITH {_EDGES}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), k AS (SELECT node, COUNT(b.dst) AS k FROM v LEFT JOIN b ON b.src = node GROUP BY 1),
    {_TRI} SELECT (SELECT COUNT(*) FROM v) AS nodes, (SELECT COUNT(*) FROM e) AS edges, (SELECT COUNT(*) FROM e WHERE src = dst) AS loops, (SELECT COUNT(*) FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst) AS mutual,
    (SELECT COUNT(*) FROM e) / (COUNT(*) * (COUNT(*) - 1)) AS density, (SELECT SUM(k) / 2 FROM k)::BIGINT AS links, MIN(k) AS min_degree, MAX(k) AS max_degree, (SELECT COUNT(*) FROM v WHERE node NOT IN (SELECT dst FROM e)) AS sources, (SELECT COUNT(*) FROM v WHERE node NOT IN (SELECT src FROM e)) AS sinks,
    (SELECT COUNT(*) FROM t) AS triangles, MIN(k) = MAX(k) AS is_regular, MIN(k) = COUNT(*) - 1 AS is_complete FROM k""",
)(lambda spark, sf: graph.properties(trade(spark, sf)).select("nodes", "edges", "loops", "mutual", "density", "links", "min_degree", "max_degree", "sources", "sinks", "triangles", "is_regular", "is_complete"))
R.add(
    "graph_topological",
    "SELECT r_regionkey AS node, 0 AS level FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 100 + n_nationkey, 1 FROM nation UNION ALL SELECT 1000 + s_suppkey, 2 FROM supplier",
)(
    lambda spark, sf: graph.topological_levels(
        table(spark, sf, "nation").selectExpr("CAST(n_regionkey AS BIGINT) AS src", "100L + n_nationkey AS dst").union(table(spark, sf, "supplier").selectExpr("100L + s_nationkey", "1000L + s_suppkey"))
    )
)
R.add("tree_paths", "SELECT r_name || '/' || n_name AS path, 2 AS depth FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 1 FROM region")(
    lambda spark, sf: table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.lit(2).alias("depth")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("path"), F.lit(1).alias("depth")))
)
