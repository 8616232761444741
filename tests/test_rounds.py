import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators.rounds import Nodes, spark_hash


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.fixture
def edges():
    rng = random.Random(5)
    return [(rng.randrange(40) * 11 - 90, rng.randrange(40) * 11 - 90) for _ in range(90)] + [(2, 2), (500, 501)]


def test_hash_is_sparks(spark):
    ids = [0, 1, -7, 2**40, -(2**63), 2**63 - 1]
    for number in (0, 5, 1000):
        want = [r.h for r in spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x long").orderBy("i").select(F.xxhash64("x", F.lit(number)).alias("h")).collect()]
        assert spark_hash(np.array(ids), number).tolist() == want


@pytest.mark.parametrize("of", [graph.pagerank, graph.eigenvector, graph.hits, graph.label_propagation, graph.strong_components])
def test_parts_do_not_change_the_result(spark, edges, monkeypatch, of):
    rows = lambda: [v for r in sorted(map(tuple, of(frame(spark, edges)).collect())) for v in r]
    whole = rows()
    monkeypatch.setattr(graph, "Nodes", functools.partial(Nodes, part=9))
    assert rows() == pytest.approx(whole, abs=1e-7)


@pytest.mark.parametrize("of", [graph.pagerank, graph.eigenvector, graph.hits])
def test_rounds_exchange_nothing(spark, edges, of):
    def written():
        all_of = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(all_of.apply(i).totalShuffleWrite() for i in range(all_of.size()))

    used = []
    for rounds in (2, 8):
        before = written()
        of(frame(spark, edges), tolerance=0, rounds=rounds).count()
        used.append(written() - before)
    assert used[1] < 1.2 * used[0]


def test_no_edges_no_rows(spark):
    for of in (graph.pagerank, graph.eigenvector, graph.hits, graph.label_propagation):
        assert of(frame(spark, [])).count() == 0
