"""Graph operators over an edge list ``(src, dst)`` of longs, and ``(src, dst, weight)`` where weights count.

Loops keep one row per node (or per pair asked for) and write each round to the shared checkpoint
folder; the driver sees a count or a norm a round. Parallel edges count once unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.components import connected_components
from quarry.operators.rounds import Nodes, Slices, Vector, spark_hash
from quarry.session import durable


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected neighbour once in each direction, without loops."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """In, out and total degree, parallel edges included."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def directed(edges: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """``(src, dst)`` as they are walked: ``out``, ``in`` or ``both`` ways, only edges whose ``kind`` is one of ``kinds`` where given."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    out, back = e.select("src", "dst"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """``(node, depth)``: least number of hops from any of ``seeds`` (node), itself at 0."""
    e = durable(directed(edges, direction, kinds))
    seen = durable(seeds.where("node IS NOT NULL").select("node").distinct().withColumn("depth", F.lit(0)))
    edge = seen
    for d in range(1, depth + 1):
        step = e.join(edge, e["src"] == edge["node"]).select(F.col("dst").alias("node")).distinct()
        edge = durable(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if edge.isEmpty():
            break
        seen = durable(seen.unionByName(edge))
    return seen


def traverse(edges: DataFrame, source: int, max_depth: int, direction: str = "out") -> DataFrame:
    """``(node, depth, path)`` breadth-first from ``source``: nodes are visited in the order of (depth, path), neighbours by id.

    A node's ``path`` is the one of its first visit. Depth-first order is left out: it is inherently sequential.
    """
    e = durable(directed(edges, direction))
    start = e.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0).alias("depth"))
    seen = durable(start.withColumn("path", F.array("node")))
    edge = seen
    for d in range(1, max_depth + 1):
        step = edge.join(e, edge["node"] == e["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        first = step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        edge = durable(first.select("node", F.lit(d).alias("depth"), "path"))
        if edge.isEmpty():
            break
        seen = durable(seen.unionByName(edge))
    return seen.orderBy("depth", "path")


def shortest_paths(edges: DataFrame, source: int, target: int | None = None, max_hops: int | None = None) -> DataFrame:
    """``(node, distance, previous, path)`` from ``source`` over ``weight``: relaxed until nothing gets shorter.

    Ties go to the smaller path. Weights may be negative; a cycle of negative weight that can be reached is an error.
    ``max_hops`` bounds the edges of a path. With ``target``, only its row: none if it cannot be reached.
    """
    spark = edges.sparkSession
    e = durable(edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight")))
    best = durable(spark.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0.0).alias("distance"), F.array(F.lit(source).cast("long")).alias("path")))
    edge, rounds = best, 0
    nodes = nodes_of(e).count()
    while max_hops is None or rounds < max_hops:
        rounds += 1
        step = edge.join(e, edge["node"] == e["src"]).select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.array_append("path", F.col("dst")).alias("path"))
        least = durable(best.unionByName(step).groupBy("node").agg(F.min(F.struct("distance", "path")).alias("s")).select("node", "s.*"))
        edge = durable(least.join(best.select("node", F.col("distance").alias("_d"), F.col("path").alias("_p")), "node", "left").where("_d IS NULL OR distance < _d OR path < _p").drop("_d", "_p"))
        best = least
        if edge.isEmpty():
            break
        if rounds > nodes:
            raise ValueError("a cycle of negative weight")
    out = best.select("node", "distance", F.get("path", F.size("path") - 2).alias("previous"), "path")
    return out if target is None else out.where(F.col("node") == target)


def path_rows(path: DataFrame) -> DataFrame:
    """The ``path`` of each row as rows ``(step, node)`` from 0."""
    return path.select(F.posexplode("path").alias("step", "node"))


def all_shortest(edges: DataFrame, source: int, target: int, direction: str = "out") -> DataFrame:
    """``(path, hops)``: every path of fewest edges. Where there are many, the rows are many: it is what is asked for."""
    e = durable(directed(edges, direction).where("src <> dst"))
    at = e.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"), F.array(F.lit(source).cast("long")).alias("path"))
    if source == target:
        return at.select("path", F.lit(0).alias("hops"))
    near = neighborhood(e, at.select("node"), 1_000_000)
    back = neighborhood(e, e.sparkSession.range(1).select(F.lit(target).cast("long").alias("node")), 1_000_000, "in")
    hit = near.where(F.col("node") == target).first()
    if hit is None:
        return at.select("path", F.lit(0).alias("hops")).limit(0)
    # only nodes on some shortest path: hops from the source and to the target add up
    on = durable(near.join(back.withColumnRenamed("depth", "left"), "node").where(F.col("depth") + F.col("left") == hit["depth"]).select("node", "depth"))
    a, b = on.select(F.col("node").alias("src"), F.col("depth").alias("i")), on.select(F.col("node").alias("dst"), F.col("depth").alias("j"))
    steps = durable(e.join(a, "src").join(b, "dst").where("j = i + 1").select("src", "dst"))
    for _ in range(hit["depth"]):
        at = at.join(steps, at["node"] == steps["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
    return at.select("path", F.lit(hit["depth"]).alias("hops"))


def hop_distances(edges: DataFrame) -> DataFrame:
    """``(source, node, d, ways)`` for all reachable pairs: breadth-first from every node, with the number of shortest ways."""
    edges = durable(edges.select("src", "dst"))  # read every round
    e = durable(edges.where("src <> dst").distinct())
    seen = durable(nodes_of(edges).select(F.col("node").alias("source"), "node", F.lit(0).alias("d"), F.lit(1).cast("double").alias("ways")))
    edge, d = seen, 0
    while not edge.isEmpty():
        d += 1
        step = edge.join(e, edge["node"] == e["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        edge = durable(step.join(seen, ["source", "node"], "left_anti").select("source", "node", F.lit(d).alias("d"), "ways"))
        seen = durable(seen.unionByName(edge))
    return seen


def closeness(edges: DataFrame) -> DataFrame:
    """Harmonic: the sum of 1 / distance to the nodes reachable, by (n - 1)."""
    edges = durable(edges.select("src", "dst"))
    dist = hop_distances(edges)
    n = nodes_of(edges).count()
    return dist.groupBy(F.col("source").alias("node")).agg((F.coalesce(F.sum(F.when(F.col("d") > 0, 1 / F.col("d"))), F.lit(0.0)) / max(1, n - 1)).alias("score"))


def betweenness(edges: DataFrame) -> DataFrame:
    """Directed, unweighted, by (n - 1)(n - 2): dependencies are summed level by level from the farthest nodes back."""
    edges = durable(edges.select("src", "dst"))
    e = durable(edges.where("src <> dst").distinct())
    dist = hop_distances(edges)
    n = nodes_of(edges).count()
    deepest = dist.agg(F.max("d")).first()[0] or 0
    total = None
    below = dist.where(F.col("d") == deepest).select("source", "node", "ways", F.lit(0.0).alias("delta"))
    parts = [below]
    for d in range(deepest - 1, -1, -1):
        here = dist.where(F.col("d") == d)
        given = (
            here.join(e, here["node"] == e["src"])
            .select("source", "node", "ways", "dst")
            .join(below.select("source", F.col("node").alias("dst"), F.col("ways").alias("_w"), "delta"), ["source", "dst"])
            .groupBy("source", "node")
            .agg(F.sum(F.col("ways") / F.col("_w") * (1 + F.col("delta"))).alias("delta"))
        )
        below = durable(here.select("source", "node", "ways").join(given, ["source", "node"], "left").fillna(0.0, ["delta"]))
        parts.append(below)
    total = reduce(DataFrame.unionByName, parts).where("source <> node").groupBy("node").agg(F.sum("delta").alias("s"))
    scale = max(1, (n - 1) * (n - 2))
    return nodes_of(edges).join(total, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) / scale).alias("score"))


def pagerank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, seeds: DataFrame | None = None) -> DataFrame:
    """``(node, score)``, summing to 1. Mass of nodes without out-edges goes where the restart goes (all nodes, or ``seeds``)."""
    e = durable(_ends(edges).distinct())
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    nodes = nodes_of(e)
    start = nodes.withColumn("in_seeds", F.lit(1)) if seeds is None else nodes.join(seeds.select("node").distinct().withColumn("in_seeds", F.lit(1)), "node", "left").fillna(0, ["in_seeds"])
    start = durable(start.join(out.withColumnRenamed("src", "node"), "node", "left").fillna(0, ["n"]))
    m = start.agg(F.sum("in_seeds")).first()[0]
    at = Nodes(start.select("node", F.col("n").cast("double").alias("n"), (F.col("in_seeds") / m).alias("restart")))
    links, scores = at.edges(e), at.columns["restart"]

    def step(part, score, n, restart):
        loose = score[n == 0].sum()
        sent = np.divide(score, n, out=np.zeros(len(score)), where=n > 0)
        new = restart[part.lo : part.hi] * (1 - alpha + alpha * loose) + alpha * part.gather(sent[part.src], np.add, 0.0)
        return [new], [np.abs(new - score[part.lo : part.hi]).sum()]

    for _ in range(rounds if at.n else 0):
        (new,), (change,) = links.round(step, [scores, at.columns["n"], at.columns["restart"]], 1)
        if scores is not at.columns["restart"]:
            scores.drop()
        scores = new
        if change < tolerance:
            break
    else:
        _settled(tolerance if at.n else 0, rounds)
    return at.frame("score double", score=scores)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")


def _settled(tolerance: float, rounds: int) -> None:
    """A loop that ran out of rounds is an error, unless no tolerance was asked for."""
    if tolerance > 0:
        raise RuntimeError(f"scores did not settle to {tolerance} in {rounds} rounds")


def _power(step, at: Nodes, tolerance: float, rounds: int) -> tuple[Vector, float]:
    """Repeat ``step(vector, factor, its forerunner, that one's factor) -> (vector, sum of squares, change)``: the vector it settles at, and the factor that makes its length 1.

    A step also tells how far the vector it begins with is from the one before, both of length 1.
    """
    old, old_by, v, by = None, 0.0, at.full(1.0), at.n**-0.5 if at.n else 1.0
    for r in range(rounds + 1 if at.n else 0):
        new, squares, change = step(v, by, old or v, old_by)
        if r and change < tolerance:
            new.drop()
            return v, by
        if r == rounds:
            break
        if old is not None:
            old.drop()
        old, old_by, v, by = v, by, new, squares**-0.5 if squares else 0.0
        if not squares:
            return v, 0.0
    _settled(tolerance if at.n else 0, rounds)
    return v, by


def _pull(by: float, old_by: float, own: float):
    """Each node's sum of ``v`` over its edges, and ``own`` times its own; the numbers are the sum of squares and the change of ``v``."""

    def do(part, v, old):
        mine = v[part.lo : part.hi] * by
        new = part.gather(v[part.src] * by, np.add, 0.0) + own * mine
        return [new], [(new * new).sum(), np.abs(mine - old[part.lo : part.hi] * old_by).sum()]

    return do


def eigenvector(edges: DataFrame, tolerance: float = 1e-6, rounds: int = 500) -> DataFrame:
    """Undirected; the shifted matrix (A + I) has the same leading vector and settles on bipartite graphs too."""
    kept = durable(_ends(edges).distinct())
    at = Nodes(nodes_of(kept))
    e = at.edges(durable(both_ways(kept)))

    def step(v, by, old, old_by):
        (new,), (squares, change) = e.round(_pull(by, old_by, 1.0), [v, old], 1)
        return new, squares, change

    v, by = _power(step, at, tolerance, rounds)
    return at.frame("score double", score=v).select("node", (F.col("score") * F.lit(by)).alias("score"))


def hits(edges: DataFrame, tolerance: float = 1e-6, rounds: int = 500) -> DataFrame:
    """``(node, hub, authority)``, both of length 1."""
    kept = durable(_ends(edges).distinct())
    at = Nodes(nodes_of(kept))
    into, outof = at.edges(kept), at.edges(kept, "dst", "src")

    def step(v, by, old, old_by):
        (a,), (_, change) = into.round(_pull(by, old_by, 0.0), [v, old], 1)
        (new,), (squares, _) = outof.round(_pull(1.0, 0.0, 0.0), [a, a], 1)
        a.drop()
        return new, squares, change

    hub, by = _power(step, at, tolerance, rounds)
    (authority,), (squares, _) = into.round(_pull(by, 0.0, 0.0), [hub, hub], 1)
    scale = squares**-0.5 if squares else 1.0
    out = at.frame("hub double, authority double", hub=hub, authority=authority)
    return out.select("node", (F.col("hub") * F.lit(by)).alias("hub"), (F.col("authority") * F.lit(scale)).alias("authority"))


def triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c)`` with a < b < c, each once; edges point from the lower degree to the higher so that hubs do not fan out."""
    e = durable(both_ways(edges))
    deg = e.groupBy("src").agg(F.count("*").alias("n"))
    d = e.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
    up = durable(d.where(F.struct("n", "src") < F.struct("m", "dst")).select("src", "dst"))
    x, y = up.select(F.col("src").alias("s"), F.col("dst").alias("x")), up.select(F.col("src").alias("s"), F.col("dst").alias("y"))
    wedge = x.join(y, "s").where("x < y")
    known = e.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    abc = F.array_sort(F.array("s", "x", "y"))
    return wedge.join(known, ["x", "y"], "left_semi").select(abc[0].alias("a"), abc[1].alias("b"), abc[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local coefficient: links among neighbours by pairs of neighbours, 0 below two neighbours."""
    edges = durable(edges.select("src", "dst"))
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    k = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    score = F.when(F.col("k") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return k.join(t, "node", "left").select("node", score.alias("score"))


def _turn(round_no: int, of: int = 2):
    """Whether a node may move in this round: an even share of them, another each time, so that neighbours do not swap for ever."""
    return F.pmod(F.xxhash64("node", F.lit(round_no // of)), F.lit(of)) == round_no % of


def label_propagation(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``(node, community)``: nodes take the commonest label around them, keep their own if it is one of the commonest, else the least.

    Half of the nodes move in a round, the other half in the next. It ends when no node would move; not to end is an error.
    """
    kept = durable(_ends(edges).distinct())
    at = Nodes(nodes_of(kept))
    e, labels, quiet = at.edges(durable(both_ways(kept))), at.full(None), 0

    def step(r):
        def do(part, label, ids):
            n, own = len(label), label[part.lo : part.hi]
            key = np.sort((part.dst.astype(np.int64) - part.lo) * n + label[part.src])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            count, at_node, vote = np.diff(np.r_[first, len(key)]), key[first] // n, key[first] % n
            order = np.lexsort((vote, vote != own[at_node], -count, at_node))
            head = order[np.flatnonzero(np.r_[True, at_node[order][1:] != at_node[order][:-1]])] if len(order) else order
            new = own.copy()
            new[at_node[head]] = vote[head]
            moves = spark_hash(ids[part.lo : part.hi], r // 2) % 2 == r % 2
            new = np.where(moves, new, own)
            return [new], [(new != own).sum()]

        return do

    for r in range(rounds if at.n else 0):
        (new,), (moved,) = e.round(step(r), [labels, at.ids], 1)
        labels.drop()
        labels, quiet = new, 0 if moved else quiet + 1
        if quiet == 2:
            break
    else:
        if at.n:
            raise RuntimeError(f"labels did not settle in {rounds} rounds")
    return _named(at, labels, "community")


def _named(at: Nodes, of: Vector, name: str) -> DataFrame:
    """``(node, name)`` where ``of`` holds a number of a node for each node."""
    (ids,), _ = Slices(at).round(lambda part, number, known: ([known[number[part.lo : part.hi].astype(np.int64)]], [0]), [of, at.ids], 1)
    return at.frame(f"{name} long", **{name: ids})


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row ``q`` of an undirected graph without parallel edges."""
    e = both_ways(edges)
    c = communities.select("node", "community")
    ends = e.join(c.withColumnsRenamed({"node": "src", "community": "a"}), "src").join(c.withColumnsRenamed({"node": "dst", "community": "b"}), "dst")
    m2 = F.sum("n")
    by = ends.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    return by.agg((F.sum("inside") / m2 - F.sum(F.col("n") * F.col("n")) / (m2 * m2)).alias("q"))


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, passes: int = 3) -> DataFrame:
    """``(node, community)`` of high modularity, named by the least node in each; parallel edges add weight, direction does not count.

    In a pass nodes move to the community beside them that gains most, then whole communities do, as nodes of a smaller graph, until none
    joins another. The next pass moves single nodes again from there; passes end when one does not raise modularity, and
    what is returned is the best one. Half of the nodes, chosen anew by a hash, move in a round; two rounds without a move, or ``rounds``, end it.
    """
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    pairs = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = durable(pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))
    m2 = e.agg(F.sum("w")).first()[0]
    own = durable(e.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct())
    best = _quality(e, own, m2, resolution) if m2 else 0.0
    for p in range(passes if m2 else 0):
        at = _moves(e, own, m2, resolution, rounds, p)
        now = _quality(e, at, m2, resolution)
        while True:
            up = durable(_between(e, at).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
            each = up.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
            to = _moves(up, each, m2, resolution, rounds, p).select(F.col("node").alias("community"), F.col("community").alias("to"))
            new = durable(at.join(to, "community").select("node", F.col("to").alias("community")))
            then = _quality(e, new, m2, resolution)
            if then <= now + 1e-9:
                break
            at, now = new, then
        if now <= best + 1e-9:
            break
        own, best = at, now
    least = own.groupBy("community").agg(F.min("node").alias("to"))
    return own.join(least, "community").select("node", F.col("to").alias("community"))


def _between(e: DataFrame, at: DataFrame) -> DataFrame:
    """``(a, b, w)``: the communities at both ends of each edge."""
    a, b = at.select(F.col("node").alias("src"), F.col("community").alias("a")), at.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    return e.join(a, "src").join(b, "dst").select("a", "b", "w")


def _quality(e: DataFrame, at: DataFrame, m2: float, resolution: float) -> float:
    by = _between(e, at).groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    return by.agg(F.sum("inside") / m2 - resolution * F.sum(F.col("k") * F.col("k")) / (m2 * m2)).first()[0]


#: Nodes up to which a row per node is broadcast to the edges; with more, both are exchanged.
FEW_NODES = 100_000


def _moves(e: DataFrame, start: DataFrame, m2: float, resolution: float, rounds: int, salt: int) -> DataFrame:
    """``(node, community)`` after rounds of moves of single nodes from ``start`` (node, community)."""
    at = durable(e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).join(start, "node").select("node", "k", "community"))
    beside = e.where("src <> dst")
    hint = F.broadcast if at.count() <= FEW_NODES else lambda d: d
    quiet = 0
    for r in range(rounds):
        near = beside.join(hint(at.select(F.col("node").alias("dst"), "community")), "dst").select(F.col("src").alias("node"), "community", "w")
        totals = at.groupBy("community").agg(F.sum("k").alias("total"))
        options = near.unionByName(at.select("node", "community", F.lit(0.0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        options = options.join(hint(totals), "community").join(hint(at.select("node", "k", F.col("community").alias("now"))), "node")
        stays = F.col("community") == F.col("now")
        gain = F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / m2
        pick = F.max_by("community", F.struct(F.round(gain, 9), stays, -F.col("community")))
        best = options.groupBy("node").agg(F.first("k").alias("k"), F.first("now").alias("now"), pick.alias("to"))
        new = durable(best.select("node", "k", "now", F.when(_turn(r + 1000 * salt), F.col("to")).otherwise(F.col("now")).alias("community")))
        quiet = quiet + 1 if new.where("community <> now").isEmpty() else 0
        at = new.drop("now")
        if quiet == 2:
            break
    return at.select("node", "community")


def simple_paths(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """``(source, node, hops, path, cost)``: all paths of up to ``max_hops`` edges from ``seeds`` (node) without a repeated node.

    ``cost`` adds ``weight``, or hops where the edges have none. Paths grow with degree to the power of ``max_hops``.
    """
    w = F.col("weight") if "weight" in edges.columns else F.lit(1)
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.min(w).alias("weight"))
    step = seeds.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"), F.array("node").alias("path")).distinct()
    step = step.withColumn("cost", F.lit(0).cast(e.schema["weight"].dataType))
    out = None
    for _ in range(max_hops):
        grown = step.join(e, (step["node"] == e["src"]) & ~F.array_contains("path", e["dst"]))
        step = grown.select("source", F.col("dst").alias("node"), F.col("hops") + 1, F.array_append("path", F.col("dst")), F.col("cost") + F.col("weight")).toDF("source", "node", "hops", "path", "cost")
        out = step if out is None else out.unionByName(step)
    return out


def k_shortest(edges: DataFrame, seeds: DataFrame, k: int, max_hops: int) -> DataFrame:
    """The ``k`` cheapest of :func:`simple_paths` per source and node, with ``rank``; ties to fewer hops, then the smaller path."""
    w = Window.partitionBy("source", "node").orderBy("cost", "hops", "path")
    return simple_paths(edges, seeds, max_hops).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand(edges: DataFrame, rows: DataFrame, key: str, depth: int) -> DataFrame:
    """``rows`` with every node within ``depth`` hops of their ``key``: ``related`` and its ``hops``, the key itself at 0."""
    e = edges.select("src", "dst").distinct()
    seen = durable(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_s")).distinct().select("_s", F.col("_s").alias("related"), F.lit(0).alias("hops")))
    edge = seen
    for d in range(1, depth + 1):
        step = edge.join(e, edge["related"] == e["src"]).select("_s", F.col("dst").alias("related")).distinct()
        edge = durable(step.join(seen, ["_s", "related"], "left_anti").withColumn("hops", F.lit(d)))
        seen = durable(seen.unionByName(edge).select("_s", "related", "hops"))
    return rows.join(seen, rows[key] == seen["_s"]).drop("_s")


def walk(edges: DataFrame, seeds: DataFrame, steps: list[str]) -> DataFrame:
    """``(node, n)``: how many walkers stand on each node after ``steps`` of out, in, both, dedup or ``limit k`` (the k least nodes).

    Walkers on one node are one row with a count, so a step costs a row per edge and not per walk.
    """
    at = seeds.select("node").groupBy("node").agg(F.count("*").alias("n"))
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = {"out": out, "in": back, "both": out.unionByName(back)}
    for s in steps:
        if s == "dedup":
            at = at.withColumn("n", F.lit(1).cast("long"))
        elif s.startswith("limit "):
            at = at.orderBy("node").limit(int(s.split()[1]))
        else:
            e = ways[s]
            at = at.join(e, at["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("n"))
    return at


def match_triples(triples: DataFrame, patterns: list[tuple[str, str, str]], optional: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Bindings of ``?names`` in patterns over ``(s, p, o)``: natural joins on shared names, outer for ``optional`` ones.

    A name twice in one pattern must be the same value. Patterns should share names in the order given.
    """
    def one(pattern: tuple[str, str, str]) -> DataFrame:
        d, names = triples, {}
        for place, term in zip(("s", "p", "o"), pattern, strict=True):
            if not term.startswith("?"):
                d = d.where(F.col(place) == term)
            elif term[1:] in names:
                d = d.where(F.col(place) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = place
        return d.select(*[F.col(c).alias(n) for n, c in names.items()])

    def join(how: str):
        return lambda a, b: a.join(b, [c for c in a.columns if c in b.columns], how)

    return reduce(join("left"), map(one, optional), reduce(join("inner"), map(one, patterns)))


def topological_levels(edges: DataFrame) -> DataFrame:
    """``(node, level)``: nodes whose predecessors are all in lower levels; an error on a cycle."""
    left, rest, parts, level = durable(edges.select("src", "dst").distinct()), durable(nodes_of(edges)), [], 0
    while not rest.isEmpty():
        free = durable(rest.join(left.select(F.col("dst").alias("node")), "node", "left_anti"))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        parts.append(free.withColumn("level", F.lit(level)))
        if len(parts) == 50:  # plans stay small
            parts = [durable(reduce(DataFrame.unionByName, parts))]
        rest = durable(rest.join(free, "node", "left_anti"))
        left = durable(left.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
        level += 1
    return reduce(DataFrame.unionByName, parts) if parts else rest.withColumn("level", F.lit(0))


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """All simple directed cycles of ``length`` nodes, as ``path`` from the least node, each once."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    paths = e.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("src").alias("start"), F.col("dst").alias("end"))
    for _ in range(length - 2):
        paths = paths.join(e, paths["end"] == e["src"]).where("dst > start AND NOT array_contains(path, dst)")
        paths = paths.select(F.array_append("path", F.col("dst")).alias("path"), "start", F.col("dst").alias("end"))
    return paths.join(e, (paths["end"] == e["src"]) & (paths["start"] == e["dst"]), "left_semi").select("path")


def on_cycles(edges: DataFrame, steps: int = 4) -> DataFrame:
    """The edges ``(src, dst)`` left when nodes that none lead to, or that lead to none, are taken away until there are none: those between cycles, and on them.

    A round takes ``steps`` layers at both ends, so a chain of n nodes is gone after n / (2 * steps) rounds.
    """
    left = durable(edges.where("src <> dst").select("src", "dst").distinct())
    n = left.count()
    while n:
        e = left
        for _ in range(steps):
            e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left, before = durable(e), n
        n = left.count()
        if n == before:
            break
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: nodes that reach each other, named by the largest of them. Every node has a row.

    What is on no cycle is taken away first. Then colours spread forward from the largest node; what reaches its colour's root backward is
    one component. Every round settles each colour's root, and the loop ends when no edge is left.
    """
    kept = durable(_ends(edges).distinct())
    at, real = Nodes(nodes_of(kept)), durable(kept.where("src <> dst"))
    ways = [at.edges(real), at.edges(real, "dst", "src")]
    # nodes of different regions reach each other one way at most; -1: settled
    region, component = at.full(0), at.full(None)

    def near(part, region):
        return (region[part.src] == region[part.dst]) & (region[part.dst] >= 0)

    def trim(part, region):
        """Nodes to or from which no edge of their region leads are alone."""
        before = region[part.lo : part.hi].copy()
        while True:
            alone = (region[part.lo : part.hi] >= 0) & (part.gather(near(part, region).astype(np.int8), np.maximum, 0) == 0)
            if not alone.any():
                break
            region[part.lo : part.hi][alone] = -1
        now = region[part.lo : part.hi].copy()
        return [now], [(now != before).sum(), (now >= 0).sum()]

    def spread(part, label, region, inside):
        """The largest label that reaches a node, within its region and, with ``inside``, within what that vector holds alike."""
        before, ok = label[part.lo : part.hi].copy(), near(part, region) & (inside[part.src] == inside[part.dst])
        while True:
            got = np.maximum(part.gather(np.where(ok, label[part.src], -1), np.maximum, -1), label[part.lo : part.hi])
            if (got == label[part.lo : part.hi]).all():
                break
            label[part.lo : part.hi] = got
        return [got], [(got != before).sum()]

    def reach(edges, label, inside):
        changed = 1
        while changed:
            (new,), (changed,) = edges.round(spread, [label, region, inside], 1)
            label.drop()
            label = new
        return label

    def settle(part, region, component, colour, hit):
        mine = slice(part.lo, part.hi)
        here = (region[mine] >= 0) & (hit[mine] > 0)
        return [np.where(here | (region[mine] < 0), -1, colour[mine]), np.where(here, colour[mine], component[mine])], [((region[mine] >= 0) & ~here).sum()]

    left = at.n
    while left:
        quiet = 0
        while left and quiet < 2:
            for way in ways:
                (new,), (gone, left) = way.round(trim, [region], 1)
                region.drop()
                region, quiet = new, 0 if gone else quiet + 1
        if not left:
            break
        colour = reach(ways[0], at.full(None), at.full(0))
        (roots,), _ = Slices(at).round(lambda part, c: ([(c[part.lo : part.hi] == np.arange(part.lo, part.hi)).astype(np.int64)], [0]), [colour], 1)
        hit = reach(ways[1], roots, colour)
        (new, named), (left,) = Slices(at).round(settle, [region, component, colour, hit], 2)
        for v in (region, component, colour, hit):
            v.drop()
        region, component = new, named
    return _named(at, component, "component")


def properties(edges: DataFrame) -> DataFrame:
    """One row of a graph's figures. Degrees, components, completeness and trees are of the graph without directions and loops."""
    e = durable(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    both = durable(both_ways(e))
    row = lambda df, **of: df.agg(*[c.alias(k) for k, c in of.items()])
    n = row(nodes_of(e), nodes=F.count("*"))
    m = row(e, edges=F.count("*"), loops=F.count_if(F.col("src") == F.col("dst")))
    mutual = row(e.where("src < dst").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi"), mutual=F.count("*"))
    of_node = nodes_of(e).join(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k")), "node", "left").fillna(0, ["k"])
    degrees = row(of_node, links=F.coalesce(F.sum("k"), F.lit(0)) / 2, min_degree=F.min("k"), max_degree=F.max("k"), isolated=F.count_if(F.col("k") == 0))
    ends = degree_centrality(e)
    flow = row(ends, sources=F.count_if(F.col("in_degree") == 0), sinks=F.count_if(F.col("out_degree") == 0))
    weak = connected_components(e)
    parts = row(nodes_of(e).join(weak, "node", "left"), components=F.count_distinct(F.coalesce("component", "node")))
    strong = row(strong_components(e), strong_components=F.count_distinct("component"))
    t = row(triangles(e), triangles=F.count("*"))
    cyclic = row(on_cycles(e), on_cycles=F.count("*"))
    out = reduce(DataFrame.crossJoin, [n, m, mutual, degrees, flow, parts, strong, t, cyclic])  # each one row
    c = F.col
    return out.withColumns(
        {
            "links": c("links").cast("long"),
            "density": F.when(c("nodes") > 1, c("edges") / (c("nodes") * (c("nodes") - 1))),
            "avg_degree": 2 * c("links") / c("nodes"),
            "reciprocity": F.when(c("edges") > c("loops"), 2 * c("mutual") / (c("edges") - c("loops"))),
            "is_connected": c("components") <= 1,
            "is_strongly_connected": c("strong_components") <= 1,
            "is_complete": 2 * c("links") == c("nodes") * (c("nodes") - 1),
            "is_cyclic": (c("on_cycles") > 0) | (c("loops") > 0),
            "is_tree": (c("components") == 1) & (c("links") == c("nodes") - 1) & (c("loops") == 0),
            "is_forest": (c("links") == c("nodes") - c("components")) & (c("loops") == 0),
            "is_regular": c("min_degree") == c("max_degree"),
        }
    ).drop("on_cycles")


def global_clustering(edges: DataFrame) -> DataFrame:
    """One row: the mean of the local coefficients of the nodes with a neighbour."""
    return clustering(edges).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("coefficient"))


def match(nodes: DataFrame, edges: DataFrame, chain: list[dict]) -> DataFrame:
    """A pattern ``(a:Label)-[:KIND]->(b:Label)...`` over ``nodes`` (id, label, ...) and ``edges`` (src, dst, kind, ...).

    ``chain`` alternates nodes ``{"as", "label", "where"}`` and edges ``{"as", "kind", "way", "where"}``; all keys but ``as`` may be missing,
    ``way`` is ``out`` (as drawn), ``in`` or ``both``. A condition speaks of the columns of its own node or edge. The result has a
    struct column per name. A name met again must be the same node.
    """
    out, last = None, None
    for i, part in enumerate(chain):
        name, where = part["as"], part.get("where", "true")
        if i % 2 == 0:
            n = nodes.where(where)
            n = n.where(F.col("label") == part["label"]) if "label" in part else n
            one = n.select(F.struct(*n.columns).alias(name))
            if out is None:
                out = one
            elif name in out.columns:
                out = out.where(F.col(f"{name}.id") == F.col("_to")).drop("_to")
            else:
                out = out.join(one, F.col("_to") == F.col(f"{name}.id")).drop("_to")
            last = name
        else:
            e = edges.where(where)
            e = e.where(F.col("kind") == part["kind"]) if "kind" in part else e
            whole = F.struct(*e.columns).alias(name)
            way = part.get("way", "out")
            ends = [("src", "dst")] * (way != "in") + [("dst", "src")] * (way != "out")
            both = reduce(DataFrame.unionByName, [e.select(whole, F.col(a).alias("_from"), F.col(b).alias("_to")) for a, b in ends])
            out = out.join(both, F.col(f"{last}.id") == F.col("_from")).drop("_from")
    return out


def has(at: DataFrame, nodes: DataFrame, condition: str) -> DataFrame:
    """Walkers (node, n) that stand on a node for which ``condition`` on ``nodes`` (id, ...) holds."""
    return at.join(nodes.where(condition).select(F.col("id").alias("node")), "node", "left_semi")


def window_top(scores: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` nodes of highest score, ties to the smaller node."""
    return scores.orderBy(F.desc("score"), "node").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node")))
