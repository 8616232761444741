import random

import numpy as np
import pytest

from quarry.llm.topk import ORACLE, Lists, op1_topk, top_k
from tests.llm.oracle import same


def test_lists_stop_early_and_exact():
    rng = np.random.default_rng(0)
    values = rng.integers(-9, 9, (700, 6))
    ids = rng.permutation(700)
    lists = Lists(ids, values)
    for q in [*rng.integers(-3, 3, (40, 6)), np.zeros(6, int)]:
        got_ids, got = lists.best(q, int(ids[3]), 5, step=2)
        scores = values @ q
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[3])[:5]
        assert list(zip((-got).tolist(), got_ids.tolist())) == want


def test_sql(spark):
    assert same(spark, op1_topk, ORACLE) == 50


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 0.0], 1), (4, [None, 1.0], 1), (5, [1.0, 2.0, 9.0], None)]
    rows += [(6, [], 2), (7, [1.0, 2.0], 3), (None, [5.0, 5.0], 3), (50, [-0.5, 0.001], 3), (0, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()]
    same_score = 256 * 256 * 5
    assert {r for r in got if r[0] == 50} == {(50, 1, 6, 0), (50, 2, 0, -128 * 256), (50, 3, 0, -128 * 256)}
    assert [r for r in got if r[0] == 0] == [(0, 1, 5, same_score), (0, 2, 7, same_score), (0, 3, 6, 0)]
    assert top_k(df, df.limit(0)).count() == 0 and top_k(df.limit(0), df.limit(0)).count() == 0


def test_queries_of_one_id_and_large_numbers(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (50, [2.0, 0.0]), (50, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id = 50"), k=2, scale=1.0).collect())
    assert got == [(50, 1, 1, 2), (50, 1, 2, 3), (50, 2, 3, 2), (50, 2, 3, 3)]
    for big in (1e30, 1e17):  # a component, then a score, that 64 bits do not hold
        wide = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="do not fit"):
            top_k(wide, wide).collect()


def test_few_rows_are_scored():
    """Where one component outweighs the rest the lists end early."""
    rng = np.random.default_rng(3)
    values = np.column_stack([rng.permutation(5000), rng.integers(0, 3, (5000, 3))])
    lists = Lists(np.arange(5000), values)
    scored = []
    floats = lists.floats

    class Seen:
        def __getitem__(self, rows):
            scored.append(len(rows))
            return floats[rows]

    lists.floats = Seen()
    ids, scores = lists.best(np.array([10, 1, 1, 1]), -1, 5)
    assert sum(scored) < 1000 and scores.tolist() == sorted((values @ [10, 1, 1, 1]).tolist(), reverse=True)[:5]


def test_blocks_do_not_matter(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0")
    assert sorted(top_k(df, q, block=30, query_block=4).collect()) == sorted(top_k(df, q).collect())
