import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.session import durable


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def test_pagerank_sums_to_one(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(50)] + [(3, 99)]
    rows = graph.pagerank(frame(spark, edges), tolerance=0, rounds=30).collect()
    assert sum(r.score for r in rows) == pytest.approx(1)
    nodes = sorted({x for e in edges for x in e})
    out = {n: sorted({b for a, b in edges if a == n}) for n in nodes}
    p = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(30):
        loose = sum(p[n] for n in nodes if not out[n])
        p = {n: (0.15 + 0.85 * loose) / len(nodes) + 0.85 * sum(p[m] / len(out[m]) for m in nodes if n in out[m]) for n in nodes}
    assert {r.node: r.score for r in rows} == pytest.approx(p, abs=1e-9)


def test_betweenness_and_closeness(spark):
    path = [(0, 1), (1, 2), (2, 3), (0, 4), (4, 2)]
    b = {r.node: r.score for r in graph.betweenness(frame(spark, path)).collect()}
    assert b == pytest.approx({0: 0, 1: 1 / 12, 2: 3 / 12, 3: 0, 4: 1 / 12})
    c = {r.node: r.score for r in graph.closeness(frame(spark, path)).collect()}
    assert c[0] == pytest.approx((1 + 1 + 0.5 + 1 / 3) / 4) and c[3] == 0


def test_weighted_paths(spark):
    edges = [(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0), (9, 1, 1.0)]
    got = graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long, weight double"), 1).collect()
    assert {r.node: (r.distance, r.previous) for r in got} == {1: (0.0, None), 3: (1.0, 1), 2: (2.0, 3), 4: (3.0, 2)}


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)]
    got = {}
    for r in graph.strong_components(frame(spark, edges)).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4, 5], [6]]


def test_communities_and_levels(spark):
    cliques = [(i, j) for base in (0, 10) for i in range(base, base + 5) for j in range(i + 1, base + 5)] + [(4, 10)]
    e = frame(spark, cliques)
    lp = graph.label_propagation(e)
    assert lp.select("community").distinct().count() == 2
    assert graph.modularity(e, lp).first().q == pytest.approx(20 / 21 - 0.5)
    with pytest.raises(ValueError):
        graph.topological_levels(frame(spark, [(1, 2), (2, 1)]))
    hub = {r.node: (r.hub, r.authority) for r in graph.hits(frame(spark, [(1, 2), (1, 3)])).collect()}
    assert hub[1] == pytest.approx((1, 0)) and hub[2] == pytest.approx((0, 0.5**0.5))
    assert {r.node: r.score for r in graph.eigenvector(frame(spark, [(1, 2), (2, 3), (1, 3)])).collect()}[1] == pytest.approx(3**-0.5)


def test_louvain_finds_cliques(spark):
    cliques = [range(0, 6), range(6, 12), range(12, 18)]
    edges = [(a, b) for c in cliques for a in c for b in c if a < b] + [(0, 6), (6, 12), (3, 3)]
    got = {r.node: r.community for r in graph.louvain(frame(spark, edges)).collect()}
    assert got == {n: c[0] for c in cliques for n in c}
    assert graph.louvain(frame(spark, [])).collect() == []


def test_louvain_beats_single_nodes(spark):
    rng = random.Random(5)
    edges = [(a, b) for a in range(40) for b in range(a) if rng.random() < (0.5 if a // 10 == b // 10 else 0.05)]
    f = frame(spark, edges)
    q = graph.modularity(f, graph.louvain(f)).first().q
    truth = spark.createDataFrame([(n, n // 10) for n in range(40)], "node long, community long")
    assert q >= graph.modularity(f, truth).first().q - 0.02 > 0.3


def test_simple_paths_and_k_shortest(spark):
    edges = [(1, 2, 5), (1, 3, 1), (3, 2, 1), (2, 4, 1), (4, 1, 1), (1, 2, 7)]
    e = spark.createDataFrame(edges, "src long, dst long, weight long")
    seed = spark.range(1, 2).withColumnRenamed("id", "node")
    paths = {tuple(r.path): r.cost for r in graph.simple_paths(e, seed, 3).collect()}
    assert paths == {(1, 2): 5, (1, 3): 1, (1, 3, 2): 2, (1, 2, 4): 6, (1, 3, 2, 4): 3}
    best = {r.node: tuple(r.path) for r in graph.k_shortest(e, seed, 1, 3).collect()}
    assert best == {2: (1, 3, 2), 3: (1, 3), 4: (1, 3, 2, 4)}


def test_match_triples(spark):
    t = spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "a"), ("b", "age", "7"), ("c", "knows", "c")], "s string, p string, o string")
    got = graph.match_triples(t, [("?x", "knows", "?y")], [("?y", "age", "?n")]).collect()
    assert {(r.x, r.y, r.n) for r in got} == {("a", "b", "7"), ("b", "a", None), ("c", "c", None)}
    assert [r.x for r in graph.match_triples(t, [("?x", "knows", "?x")]).collect()] == ["c"]


def test_long_chains_and_knots(spark):
    chain = [(i + 1, i) for i in range(40)] + [(500, 501), (501, 502), (502, 500), (502, 40), (0, 600), (600, 601), (601, 600), (7, 7)]
    got = {}
    for r in graph.strong_components(frame(spark, chain)).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert sum(map(len, got.values())) == 46 and sorted(map(sorted, (v for v in got.values() if len(v) > 1))) == [[500, 501, 502], [600, 601]]
    assert graph.strong_components(frame(spark, [])).count() == 0
    levels = {r.node: r.level for r in graph.topological_levels(frame(spark, [(i, i + 1) for i in range(12)])).collect()}
    assert levels == {i: i for i in range(13)}


def test_strong_components_against_brute_force(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    got = {r.node: r.component for r in graph.strong_components(frame(spark, edges)).collect()}
    assert got == {n: max(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_loops_that_do_not_settle_are_errors(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 1), (1, 3), (4, 1)])
    with pytest.raises(RuntimeError):
        graph.pagerank(e, tolerance=1e-12, rounds=2)
    with pytest.raises(RuntimeError):
        graph.eigenvector(e, tolerance=1e-12, rounds=2)
    with pytest.raises(ValueError):
        graph.shortest_paths(spark.createDataFrame([(1, 2, -1.0), (2, 1, 0.5), (2, 3, 1.0)], "src long, dst long, weight double"), 1).collect()


def test_traversals_and_paths(spark):
    e = frame(spark, [(1, 3), (1, 2), (3, 5), (2, 4), (2, 5), (5, 1), (4, 6), (5, 6), (None, 1)])
    assert [(r.node, r.depth) for r in graph.traverse(e, 1, 2).collect()] == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
    assert [r.node for r in graph.traverse(e, 6, 1, "in").collect()] == [6, 4, 5]
    assert sorted(tuple(r.path) for r in graph.all_shortest(e, 1, 6).collect()) == [(1, 2, 4, 6), (1, 2, 5, 6), (1, 3, 5, 6)]
    assert graph.all_shortest(e, 6, 1).count() == 0 and [tuple(r.path) for r in graph.all_shortest(e, 1, 1).collect()] == [(1,)]
    w = spark.createDataFrame([(1, 2, 4.0), (1, 3, 1.0), (3, 2, -1.0), (2, 4, 1.0)], "src long, dst long, weight double")
    assert [(r.step, r.node) for r in graph.path_rows(graph.shortest_paths(w, 1, 4)).orderBy("step").collect()] == [(0, 1), (1, 3), (2, 2), (3, 4)]
    assert graph.shortest_paths(w, 1, 4, max_hops=2).first().distance == 5.0 and graph.shortest_paths(w, 4, 1).count() == 0
    kinds = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (4, 2, "a")], "src long, dst long, kind string")
    seeds = spark.createDataFrame([(2,)], "node long")
    near = lambda *a: {r.node: r.depth for r in graph.neighborhood(kinds, seeds, 2, *a).collect()}
    assert near("both") == {2: 0, 1: 1, 3: 1, 4: 1} and near("in", ["a"]) == {2: 0, 1: 1, 4: 1} and near("out", ["a"]) == {2: 0}


def test_properties_of_small_graphs(spark):
    of = lambda edges: graph.properties(frame(spark, edges)).first()
    tree = of([(1, 2), (1, 3)])
    assert (tree.is_tree, tree.is_forest, tree.is_cyclic, tree.is_connected, tree.components, tree.strong_components) == (True, True, False, True, 1, 3)
    ring = of([(1, 2), (2, 3), (3, 1), (3, 3)])
    assert (ring.is_tree, ring.is_cyclic, ring.is_complete, ring.is_regular, ring.is_strongly_connected, ring.triangles, ring.loops) == (False, True, True, True, True, 1, 1)


def test_match(spark):
    nodes = spark.createDataFrame([("a", "P", 1), ("b", "P", 2), ("c", "Q", 3)], "id string, label string, x int")
    edges = spark.createDataFrame([("a", "b", "K", 5), ("b", "c", "L", 6), ("c", "a", "L", 7), ("b", "b", "K", 8)], "src string, dst string, kind string, w int")
    two = graph.match(nodes, edges, [{"as": "m", "label": "P"}, {"as": "e", "kind": "K"}, {"as": "n"}, {"as": "f", "where": "w > 5"}, {"as": "o", "label": "Q"}])
    assert [(r.m.id, r.e.w, r.n.id, r.f.w, r.o.x) for r in two.orderBy("m.id").collect()] == [("a", 5, "b", 6, 3), ("b", 8, "b", 6, 3)]
    again = graph.match(nodes, edges, [{"as": "m"}, {"as": "e", "kind": "K"}, {"as": "m"}])
    assert [r.m.id for r in again.collect()] == ["b"]
    both = graph.match(nodes, edges, [{"as": "m", "where": "id = 'c'"}, {"as": "e", "way": "both"}, {"as": "n"}])
    assert sorted(r.n.id for r in both.collect()) == ["a", "b"]
    at = spark.createDataFrame([("a", 2), ("c", 1)], "node string, n long")
    assert [tuple(r) for r in graph.has(at, nodes, "x > 1").collect()] == [("c", 1)]


def test_kept_tables_of_a_loop_keep_small_estimates(spark):
    at = spark.range(5).selectExpr("id AS node", "id AS label")
    for _ in range(12):
        at = durable(at.join(at.withColumnRenamed("label", "other"), "node").join(at.select("node"), "node").select("node", F.least("label", "other").alias("label")))
    assert at._jdf.queryExecution().analyzed().stats().sizeInBytes() < 2**64
    assert at.count() == 5 and at.where("node = label").count() == 5


@pytest.mark.parametrize("measure", [graph.betweenness, graph.closeness])
def test_edges_are_made_once(spark, measure):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = measure(frame(spark, [(0, 1), (1, 2), (2, 3), (0, 4), (4, 2)]).mapInArrow(count, "src long, dst long")).collect()
    assert len(rows) == 5 and made.value == 5
