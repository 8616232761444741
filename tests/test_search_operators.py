import math
import random

import numpy as np
import pytest

from quarry.operators import learning, search


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, k, metric, threshold=None):
    out = []
    for q, y in rows:
        if q % 4 or y is None:
            continue
        y = np.array(y, np.float32).astype(float)
        near = []
        for i, x in rows:
            if i == q or x is None:
                continue
            x = np.array(x, np.float32).astype(float)
            n = math.sqrt(x @ x) * math.sqrt(y @ y)
            d = {"ip": -(x @ y), "l2": ((x - y) ** 2).sum(), "cosine": 1 - x @ y / n if n else 1.0}[metric]
            if threshold is None or (d <= threshold if metric == "l2" else 1 - d >= threshold if metric == "cosine" else -d >= threshold):
                near.append((round(d, 9), i))
        out += [(q, i, d, r + 1) for r, (d, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def test_similar_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (64, [0.0] * 4)]
    v = frame(spark, rows)
    q = v.where("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    for metric, threshold in (("cosine", None), ("l2", 9.0), ("ip", 2.0), ("cosine", 0.5)):
        for block in (8192, 7):
            got = search.similar(v, q, 5, metric, threshold, block=block, query_block=5 if block == 7 else 1024).collect()
            assert sorted((r.query_id, r.vec_id, round(r.distance, 9), r.rank) for r in got) == brute(rows, 5, metric, threshold)
    assert search.similar(v, q.limit(0)).count() == 0 and search.similar(v.limit(0), q).count() == 0
    with pytest.raises(Exception, match="components"):
        search.similar(v, spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<float>")).collect()


def test_recall_of_the_indexes(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.6
    v = frame(spark, [(i, row.tolist()) for i, row in enumerate(x)])
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    found = search.ivf_search(v, q)
    assert found.count() == 1500 and search.recall(found, search.similar(v, q, 10, "l2")).first().recall >= 0.9
    exact = search.similar(v, q, 10)
    assert search.recall(search.quantised_search(v, q, 10, over=4), exact).first().recall >= 0.99


def test_one_hot_and_fuzzy(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "c")], "k int, v string")
    assert sorted((r.k, r.slot, r.slots) for r in search.one_hot(df, "k", "v").collect()) == [(1, 1, 3), (2, None, None), (3, 0, 3), (4, 1, 3), (5, 2, 3)]
    words = spark.createDataFrame([("Password",), ("pasword",), ("word",), ("passwords!",), (None,)], "w string")
    assert {r.w: r.edits for r in search.fuzzy(words, "w", "password").collect()} == {"Password": 0, "pasword": 1, "passwords!": 2}


def test_count_min(spark):
    rng = random.Random(7)
    values = [min(rng.randrange(1, 400), rng.randrange(1, 400)) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x long")
    got = {r.x: r.estimate for r in search.count_min_estimate(search.count_min(df, "x", 4, 256), df.union(spark.createDataFrame([(9999,)], "x long")), "x", 4, 256).where("x IS NOT NULL").collect()}
    assert all(got[x] >= values.count(x) for x in set(values)) and len(got) == len(set(values)) + 1
    assert sum(got[x] - values.count(x) > 2.72 / 256 * 5000 for x in set(values)) <= 0.05 * len(set(values))


def test_dbscan_against_brute_force(spark):
    rng = random.Random(8)
    pts = [(i, rng.choice([0, 5, 9]) + rng.gauss(0, 0.7), rng.choice([0, 5]) + rng.gauss(0, 0.7)) for i in range(150)] + [(900, 50.0, 50.0), (901, 0.0, 0.0), (902, 0.0, 0.0), (903, None, 1.0)]
    eps, least = 0.6, 6
    got = {r.k: r.cluster for r in learning.dbscan(spark.createDataFrame(pts, "k long, a double, b double"), "k", "a", "b", eps, least).collect()}
    ok = [p for p in pts if p[1] is not None]
    near = {p[0]: [q for q in ok if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= eps * eps] for p in ok}
    core = {k for k, n in near.items() if len(n) >= least}
    label = {k: k for k in core}
    changed = True
    while changed:
        changed = False
        for k in core:
            m = min(label[q[0]] for q in near[k] if q[0] in core)
            changed |= m < label[k]
            label[k] = m
    assert got.pop(903) is None
    for p in ok:
        if p[0] in core:
            assert {k for k in core if got[k] == got[p[0]]} == {k for k in core if label[k] == label[p[0]]}
        else:
            beside = [q for q in near[p[0]] if q[0] in core]
            best = min(beside, key=lambda q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, q[0]))[0] if beside else None
            assert got[p[0]] == (-1 if best is None else got[best])
    assert len(set(got.values())) > 3


def test_few_queries_are_compared_at_once(spark):
    vectors = spark.range(300).selectExpr("id AS vec_id", "array(cast(id AS double), 1D) AS embedding")
    asked = vectors.selectExpr("vec_id AS query_id", "embedding AS query")

    def sizes(ids, x, some, y):
        return some, np.full(len(some), len(some))

    rows = search._blocks(vectors, asked, 1000, 1000, sizes, "query_id long, n long").collect()
    assert sorted(r.query_id for r in rows) == list(range(300)) and max(r.n for r in rows) <= 64


def test_ivf_of_all_lists_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(i % 2 * 9, 1, 3)]) for i in range(400)] + [(400, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    key = lambda d: sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in d.collect())
    want = key(search.similar(vectors, asked, 5, "l2"))
    assert key(search.ivf_search(vectors, asked, 5, lists=4, probes=4, block=40, query_block=7)) == want  # lists spread over units
    assert key(search.ivf_search(vectors, asked, 5, lists=12, probes=12, block=1000)) == want  # many lists a unit
    one = search.ivf_search(vectors, asked, 5, lists=2, probes=1, block=64, query_block=8).collect()
    assert all((r.vec_id - r.query_id) % 2 == 0 for r in one) and len(one) == 100


def test_tfidf_keeps_nothing_and_shares_its_exchange(spark, monkeypatch):
    monkeypatch.setattr(search, "durable", None)
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id long, text string")
    d = search.tfidf(docs, "doc_id", "text")
    assert sorted((r.doc_id, r.term, r.tf, r.df) for r in d.collect()) == [(1, "a", 2, 1), (1, "b", 1, 2), (2, "b", 1, 2)]
    assert d._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1
