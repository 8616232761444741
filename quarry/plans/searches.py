"""Vector, text and hybrid search, sketches, documents, updates and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregates, learning, search, versions
from quarry.plans.sqlviews import adder
from quarry.registry import Registry
from quarry.session import table

R = Registry()
sql = adder(R)
_Q = "q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0)"
_COS = "1 - list_inner_product(e.embedding::DOUBLE[], q.query::DOUBLE[]) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.query::DOUBLE[], q.query::DOUBLE[])))"
_L2 = "list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.query::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_IP = "-list_inner_product(e.embedding::DOUBLE[], q.query::DOUBLE[])"


def _queries(spark, sf):
    """The stated query set: every row whose id is divisible by 20."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")


def _nearest(expr: str, where: str = "true") -> str:
    return f"WITH {_Q}, d AS (SELECT query_id, vec_id, ROUND({expr}, 12) AS distance FROM embeddings e, q WHERE vec_id <> query_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d WHERE {where}) SELECT query_id, vec_id, ROUND(distance, 6) AS distance, rank FROM r WHERE rank <= 10"


def _vector(metric, threshold=None):
    return lambda spark, sf: search.similar(table(spark, sf, "embeddings").select("vec_id", "embedding"), _queries(spark, sf), 10, metric, threshold).withColumn("distance", F.round("distance", 6))


R.add("vector_cosine", _nearest(_COS))(_vector("cosine"))
R.add("vector_l2", _nearest(_L2))(_vector("l2"))
R.add("vector_inner_product", _nearest(_IP))(_vector("ip"))
R.add("vector_threshold", _nearest(_COS, "1 - distance >= 0.2"))(_vector("cosine", 0.2))
def _ivf(spark, sf):
    return search.ivf_search(table(spark, sf, "embeddings").select("vec_id", "embedding"), _queries(spark, sf))


R.add("vector_ivf")(_ivf)
R.add("vector_ivf_recall", "SELECT COUNT(*) > 0 AS enough FROM embeddings")(
    lambda spark, sf: search.recall(_ivf(spark, sf), search.similar(table(spark, sf, "embeddings").select("vec_id", "embedding"), _queries(spark, sf), 10, "l2")).select((F.col("recall") >= 0.9).alias("enough"))
)
R.add("vector_metadata_filter", _nearest(_COS).replace("FROM embeddings e, q WHERE", "FROM embeddings e, q WHERE (label IN (1, 2, 3) OR label > 7) AND NOT label = 2 AND"))(
    lambda spark, sf: search.similar(table(spark, sf, "embeddings").where("(label IN (1, 2, 3) OR label > 7) AND NOT label = 2").select("vec_id", "embedding"), _queries(spark, sf), 10).withColumn("distance", F.round("distance", 6))
)
R.add("vector_join", f"WITH v AS ({_nearest(_COS)}) SELECT v.query_id, v.vec_id, e.label FROM v JOIN embeddings e USING (vec_id)")(
    lambda spark, sf: _vector("cosine")(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label")
)
_WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)"
_BM = f"{_WORDS}, n AS (SELECT COUNT(*) AS docs, AVG(len(w)) AS a FROM w), h AS (SELECT doc_id, len(w) AS l, t, len(list_filter(w, lambda x: x = t)) AS tf FROM w, (VALUES ('token'), ('password'), ('the')) AS q(t)), k AS (SELECT * FROM h WHERE tf > 0), f AS (SELECT t, COUNT(*) AS df FROM k GROUP BY t), bm AS (SELECT doc_id, SUM(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM k JOIN f USING (t), n GROUP BY doc_id)"


def _bm(spark, sf):
    return search.bm25(table(spark, sf, "documents"), "doc_id", "text", ["token", "password", "the"])


R.add("text_bm25", f"WITH {_BM} SELECT doc_id, ROUND(score, 8) AS score FROM bm")(lambda spark, sf: _bm(spark, sf).withColumn("score", F.round("score", 8)))
R.add("text_term_counts", f"WITH {_WORDS} SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2")(lambda spark, sf: search.tokens(table(spark, sf, "documents"), "doc_id", "text"))
R.add("text_fuzzy", f"WITH {_WORDS}, t AS (SELECT doc_id, unnest(w) AS term FROM w) SELECT doc_id, term, CAST(MIN(levenshtein(term, 'thhe')) AS INTEGER) AS edits, COUNT(*) AS tf FROM t WHERE levenshtein(term, 'thhe') <= 2 GROUP BY 1, 2")(
    lambda spark, sf: search.fuzzy(search.tokens(table(spark, sf, "documents"), "doc_id", "text"), "term", "thhe").select("doc_id", "term", "edits", "tf")
)
#: The vector list beside the text list: likeness of each document's vector (of the same id) to that of vector 1.
_LEN = "SELECT e.vec_id AS doc_id, ROUND(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 1 AND e.vec_id <> 1"
_TOP = "(SELECT doc_id, row_number() OVER (ORDER BY ROUND(score, 8) DESC, doc_id) AS rank FROM {0} QUALIFY rank <= 50)"


def _long(spark, sf):
    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    asked = e.where("vec_id = 1").select(F.col("embedding").alias("query")).limit(1)  # one row
    near = e.where("vec_id <> 1").crossJoin(F.broadcast(asked))
    return near.select(F.col("vec_id").alias("doc_id"), F.round(1 - search.distance(F.col("embedding"), F.col("query"), "cosine"), 9).alias("score"))


R.add("hybrid_rrf", f"WITH {_BM}, ln AS ({_LEN}), u AS (SELECT * FROM {_TOP.format('bm')} UNION ALL SELECT * FROM {_TOP.format('ln')}) SELECT doc_id, ROUND(SUM(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY 1")(
    lambda spark, sf: search.fuse_rrf([search.head(_bm(spark, sf).withColumn("score", F.round("score", 8)), "doc_id", 50), search.head(_long(spark, sf), "doc_id", 50)], "doc_id").withColumn("score", F.round("score", 9))
)
_SC = "(SELECT doc_id, (score - MIN(score) OVER ()) / (MAX(score) OVER () - MIN(score) OVER ()) AS s FROM {0})"
R.add("hybrid_linear", f"WITH {_BM}, ln AS ({_LEN}) SELECT doc_id, ROUND(0.7 * COALESCE(x.s, 0) + 0.3 * COALESCE(y.s, 0), 8) AS score FROM {_SC.format('bm')} x FULL JOIN {_SC.format('ln')} y USING (doc_id)")(
    lambda spark, sf: search.fuse_linear(_bm(spark, sf), _long(spark, sf), "doc_id", 0.7).withColumn("score", F.round("score", 8))
)
_DB = "(SELECT doc_id, LEAST(GREATEST((score - (AVG(score) OVER () - 3 * stddev_pop(score) OVER ())) / (6 * stddev_pop(score) OVER ()), 0), 1) AS s FROM {0})"
R.add("hybrid_dbsf", f"WITH {_BM}, ln AS ({_LEN}) SELECT doc_id, ROUND(SUM(s), 8) AS score FROM (SELECT * FROM {_DB.format('bm')} UNION ALL SELECT * FROM {_DB.format('ln')}) GROUP BY 1")(
    lambda spark, sf: search.fuse_dbsf(_bm(spark, sf), _long(spark, sf), "doc_id").withColumn("score", F.round("score", 8))
)
R.add("hybrid_filter_then_search", _nearest(_COS).replace("FROM embeddings e, q WHERE", "FROM embeddings e, q WHERE label = 3 AND"))(
    lambda spark, sf: search.similar(table(spark, sf, "embeddings").where("label = 3").select("vec_id", "embedding"), _queries(spark, sf), 10).withColumn("distance", F.round("distance", 6))
)

# sketches, each beside the exact count it stands for
def _within(name: str, spark, sf):
    """Approximate and exact counts of users side by side: whether they are within 5 in 100."""
    e = table(spark, sf, "events")
    exact = F.count_distinct("user_id").alias("exact")
    if name == "merge":
        about = e.groupBy("event_type").agg(F.hll_sketch_agg("user_id", 12).alias("s")).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("about"))
        both = about.crossJoin(e.agg(exact))
    else:
        both = e.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 12)).alias("about"), exact)
    keys = [c for c in both.columns if c == "event_type"]
    return both.select(*keys, "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


R.add("sketch_hll", "SELECT event_type, COUNT(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY 1")(lambda spark, sf: _within("each", spark, sf))
R.add("sketch_hll_merge", "SELECT COUNT(DISTINCT user_id) AS exact, true AS close FROM events")(lambda spark, sf: _within("merge", spark, sf))


def _quantiles(spark, sf):
    """Whether the approximate quantiles lie between the exact ones two hundredths to either side."""
    li = table(spark, sf, "lineitem")
    about = li.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.5, 0.9], 1000).alias("q"))
    exact = aggregates.nearest_rank(li, ["l_returnflag"], "l_extendedprice", {"a": 0.48, "b": 0.52, "c": 0.88, "d": 0.92})
    return about.join(exact, "l_returnflag").select("l_returnflag", (F.col("q")[0].between(F.col("a"), F.col("b")) & F.col("q")[1].between(F.col("c"), F.col("d"))).alias("close"))


R.add("sketch_quantile", "SELECT DISTINCT l_returnflag, true AS close FROM lineitem")(_quantiles)


def _counted(spark, sf):
    """Count-min estimates of every user's events beside the exact counts: never below, and within e / width of all."""
    e = table(spark, sf, "events")
    exact = e.groupBy("user_id").agg(F.count("*").alias("n"))
    about = search.count_min_estimate(search.count_min(e, "user_id"), e, "user_id")
    total = e.agg(F.count("*").alias("all"))
    both = exact.join(about, "user_id").crossJoin(F.broadcast(total))
    over = F.col("estimate") - F.col("n")
    return both.agg(F.count("*").alias("users"), (F.min(over) >= 0).alias("never_below"), (F.sum((over > 2.72 / 2048 * F.col("all")).cast("int")) <= 0.05 * F.count("*")).alias("close"))


R.add("sketch_count_min", "SELECT COUNT(DISTINCT user_id) AS users, true AS never_below, true AS close FROM events")(_counted)
R.add("sketch_heavy_hitters", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")(lambda spark, sf: table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10))
R.add("filter_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")(
    lambda spark, sf: table(spark, sf, "orders").join(table(spark, sf, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
)

# documents and key-value
sql("document_path", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("document_nested_group", "SELECT CAST(get_json_object(props, '$.k') AS BIGINT) % 10 AS k, COUNT(*) AS n FROM events GROUP BY 1", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, COUNT(*) AS n FROM events GROUP BY 1")
R.add("document_nested_set", "SELECT event_id, value * 2 AS v, event_type AS kind FROM events")(
    lambda spark, sf: table(spark, sf, "events")
    .select("event_id", F.struct(F.struct("value", F.col("event_type").alias("kind")).alias("inner")).alias("body"))
    .withColumn("body", F.col("body").withField("inner.value", F.col("body.inner.value") * 2))
    .select("event_id", F.col("body.inner.value").alias("v"), F.col("body.inner.kind").alias("kind"))
)
sql("kv_prefix", "SELECT c_name AS key, to_json(named_struct('bal', c_mktsegment)) AS value FROM customer WHERE c_name LIKE 'Customer#00%'", "SELECT c_name AS key, CAST(json_object('bal', c_mktsegment) AS VARCHAR) AS value FROM customer WHERE c_name LIKE 'Customer#00%'")

# updates as functions of the table
R.add("update_where", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM customer")(
    lambda spark, sf: versions.update(table(spark, sf, "customer"), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.col("c_acctbal") + 10}).select("c_custkey", "c_acctbal")
)
R.add("delete_where", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 50000, false)")(lambda spark, sf: versions.delete(table(spark, sf, "orders"), F.col("o_totalprice") < 50000).select("o_orderkey"))
R.add("merge_upsert", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")(
    lambda spark, sf: versions.upsert(table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v"), table(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_acctbal AS v"), "k")
)
R.add("as_of_version", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY 1")(
    lambda spark, sf: versions.as_of(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "1996-06-30", "o_orderkey").select("o_custkey", "o_orderkey")
)
R.add("change_events", "SELECT user_id, COUNT(*) AS n FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type GROUP BY 1")(
    lambda spark, sf: versions.changes(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.count("*").alias("n"))
)

# learning
R.add("ml_naive_bayes")(lambda spark, sf: learning.evaluate(spark, sf, "bayes"))
R.add("ml_logistic")(lambda spark, sf: learning.evaluate(spark, sf, "logistic"))
R.add("ml_kmeans")(lambda spark, sf: learning.clusters(table(spark, sf, "embeddings")))
R.add("ml_classify", "SELECT doc_id, true AS known FROM documents")(
    lambda spark, sf: learning.classify_documents(spark, sf, "logistic").select("doc_id", (F.col("class").isin(0, 1) & F.col("proba").between(0.5, 1)).alias("known"))
)
R.add("ml_predict_proba")(lambda spark, sf: learning.classify_documents(spark, sf, "bayes"))
R.add("ml_unknown_model", 'SELECT doc_id, CAST(NULL AS INTEGER) AS "class", CAST(NULL AS DOUBLE) AS proba FROM documents')(lambda spark, sf: learning.classify(table(spark, sf, "documents"), None))
R.add("ml_one_hot", "SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS slot, (SELECT COUNT(DISTINCT p_type) FROM part) AS slots FROM part WHERE p_type IS NOT NULL")(
    lambda spark, sf: search.one_hot(table(spark, sf, "part"), "p_partkey", "p_type").select("p_partkey", "p_type", F.col("slot").cast("long").alias("slot"), "slots")
)
R.add("ml_dbscan")(lambda spark, sf: learning.dbscan(table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 10).alias("price")), "p_partkey", "p_size", "price", 1.5, 6))

# fusion of a structured list with vectors
_VEC = f"vs AS ({_LEN})"
R.add("hybrid_rerank", f"WITH {_BM}, {_VEC}, st AS (SELECT doc_id, s AS score FROM {_SC.format('bm')}) SELECT doc_id, ROUND(0.6 * st.score + 0.4 * COALESCE(vs.score, 0), 8) AS score FROM st LEFT JOIN vs USING (doc_id)")(
    lambda spark, sf: search.rerank(search.scaled(_bm(spark, sf)), _long(spark, sf), "doc_id", 0.4).withColumn("score", F.round("score", 8))
)
R.add("hybrid_search_then_filter", f"WITH {_BM}, {_VEC}, hd AS (SELECT doc_id, score FROM vs ORDER BY score DESC, doc_id LIMIT 200) SELECT doc_id, score FROM hd WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")(
    lambda spark, sf: search.head(_long(spark, sf), "doc_id", 200).join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "score")
)
R.add("search_ranked", f"WITH {_BM} SELECT doc_id, ROUND(score, 8) AS _score, CAST(row_number() OVER (ORDER BY ROUND(score, 8) DESC, doc_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 20")(
    lambda spark, sf: search.head(_bm(spark, sf).withColumn("score", F.round("score", 8)), "doc_id", 20).select("doc_id", F.col("score").alias("_score"), "rank")
)

# more on keys, values and rows
R.add(
    "kv_compare_and_set",
    "SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL AND c_nationkey = 3 THEN 99 ELSE c_nationkey END AS c_nationkey, CASE WHEN s_suppkey IS NOT NULL THEN c_nationkey = 3 END AS swapped FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
)(
    lambda spark, sf: versions.compare_and_set(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", table(spark, sf, "supplier").selectExpr("s_suppkey AS c_custkey", "3 AS expected", "99 AS new")
    )
)
R.add("insert_rows", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_name, NULL FROM supplier")(
    lambda spark, sf: versions.insert(
        table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_acctbal AS bal"), table(spark, sf, "supplier").selectExpr("explode(array(s_suppkey + 1000000, 0)) AS k", "s_name AS name"), "k"
    )
)
R.add(
    "change_log",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'delete' ELSE 'update' END AS op, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 10 END AS after_bal, c_acctbal AS before_bal FROM customer WHERE c_custkey % 5 = 0 OR c_mktsegment = 'BUILDING'",
)(
    lambda spark, sf: versions.change_log(
        table(spark, sf, "customer"),
        versions.update(table(spark, sf, "customer").where("c_custkey % 5 <> 0"), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.col("c_acctbal") + 10}),
        "c_custkey",
        ["c_name"],
    )
    .where("before.c_name IS NULL AND after.c_name IS NULL")
    .select("c_custkey", "op", F.col("after.c_acctbal").alias("after_bal"), F.col("before.c_acctbal").alias("before_bal"))
)
