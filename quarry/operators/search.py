"""Vector, text and hybrid search as DataFrame operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import durable


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine: 1 - cos, 1 if either is zero; l2: squared; ip: minus the inner product."""
    if metric == "ip":
        return -dot(a, b)
    if metric == "l2":
        return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norms)


#: Queries whose distances to a block are in memory together: 64 by 8,192 are 4 MB a matrix.
AT_ONCE = 64


def _blocks(vectors: DataFrame, queries: DataFrame, block: int, query_block: int, search, schema: str) -> DataFrame:
    """``search(ids, matrix, query ids, query matrix) -> columns`` of each block of ``vectors`` with each block of ``queries``.

    Blocks hold about ``block`` and ``query_block`` rows, so a task's work is bounded however large both sides are, and nothing is
    broadcast. ``search`` gets ``AT_ONCE`` queries at a time, which bounds its matrices. All vectors must have one length; null ones take no part.
    """
    base = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    ask = queries.where("query_id IS NOT NULL AND query IS NOT NULL").select("query_id", F.col("query").cast("array<double>").alias("v"))
    blocks, asks = max(1, -(-base.count() // block)), max(1, -(-ask.count() // query_block))
    deal = lambda key, n: F.pmod(F.xxhash64(key, "v"), F.lit(n)).cast("int")
    left = base.withColumn("b", deal("vec_id", blocks)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = ask.withColumn("a", deal("query_id", asks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = [c.split()[0] for c in schema.split(", ")]

    def go(q, c):
        import pandas as pd

        if not len(q) or not len(c):
            return pd.DataFrame({n: [] for n in names})
        x, y = np.stack(c["v"].to_numpy()), np.stack(q["v"].to_numpy())
        if x.shape[1] != y.shape[1]:
            raise ValueError(f"vectors of {x.shape[1]} and {y.shape[1]} components")
        ids, asked = c["vec_id"].to_numpy(), q["query_id"].to_numpy()
        found = [search(ids, x, asked[i : i + AT_ONCE], y[i : i + AT_ONCE]) for i in range(0, len(asked), AT_ONCE)]
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return right.groupBy("a", "b").cogroup(left.groupBy("a", "b")).applyInPandas(go, schema)


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Of each row of ``y`` to each row of ``x``, rounded to 12 places so that equal vectors are equally far."""
    inner = y @ x.T
    if metric == "ip":
        d = -inner
    elif metric == "l2":
        d = np.maximum((y * y).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * inner, 0)
    else:
        norms = np.sqrt((y * y).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
        d = np.where(norms == 0, 1.0, 1 - inner / np.where(norms == 0, 1, norms))
    return np.round(d, 12)


def _head(score: np.ndarray, ids: np.ndarray, own: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` least scores of each row, ties to the smaller id, without a row's own id."""
    rows, cols = [], []
    for i in range(len(own)):
        at = np.flatnonzero(allowed[i] & (ids != own[i]))
        if len(at) > k:
            edge = np.partition(score[i, at], k - 1)[k - 1]
            at = at[score[i, at] <= edge]
        at = at[np.lexsort((ids[at], score[i, at]))[:k]]
        rows.append(np.full(len(at), i))
        cols.append(at)
    return np.concatenate(rows), np.concatenate(cols)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", threshold: float | None = None, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (vec_id, embedding) per row of ``queries`` (query_id, query): ``query_id, vec_id, distance, rank``.

    Exact, ties to the smaller id, never the query's own id. ``threshold``: distance at most (l2), or score (1 - distance, or inner product) at least.
    """

    def search(ids, x, asked, y):
        d = distances(x, y, metric)
        ok = np.ones(d.shape, bool) if threshold is None else d <= threshold if metric == "l2" else 1 - d >= threshold if metric == "cosine" else -d >= threshold
        i, j = _head(d, ids, asked, ok, k)
        return asked[i], ids[j], d[i, j]

    return _ranked(_blocks(vectors, queries, block, query_block, search, "query_id long, vec_id long, distance double"), k)


def quantised_search(vectors: DataFrame, queries: DataFrame, k: int = 10, over: int = 32, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """The ``k`` nearest by cosine: a first pass over vectors of bytes keeps ``over * k`` a query, which are ranked again exactly.

    A vector's bytes are its components by its greatest, times 127; the first pass adds whole numbers alone.
    """

    def search(ids, x, asked, y):
        byte = lambda v: np.round(v * 127 / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-30))
        small, wanted = byte(x), byte(y)  # whole numbers, which doubles hold exactly
        rough = -np.round(wanted @ small.T / np.sqrt(np.maximum((small * small).sum(axis=1), 1)), 9)
        i, j = _head(rough, ids, asked, np.ones(rough.shape, bool), k * over)
        return asked[i], ids[j], rough[i, j], distances(x, y, "cosine")[i, j]

    found = _blocks(vectors, queries, block, query_block, search, "query_id long, vec_id long, rough double, distance double")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rough", "vec_id"))).where(F.col("_r") <= k * over)
    return _ranked(first.select("query_id", "vec_id", "distance"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of ``exact`` (query_id, vec_id) that ``found`` has."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("_hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg((F.count("_hit") / F.count("*")).alias("recall"))


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, probes: int | None = None, sample: int = 20_000, aim: float = 0.97, trial: int = 200, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """Nearest by squared distance among the lists whose centres are nearest to the query: an inverted file over k-means.

    ``lists`` centres (by default the square root of the number of vectors, 1024 at most) are fitted on about ``sample`` vectors; every
    vector is in the list of its centre. ``probes``, where not given, is measured: for about ``trial`` of the queries the exact ``k`` nearest are
    found, and as many lists are probed as hold ``aim`` of those. Queries meet vectors in units of lists of about ``block`` vectors.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    n = vectors.count()
    lists = lists or max(1, min(1024, int(n**0.5)))
    v = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=lists, seed=3, maxIter=10).fit(v.sample(min(1.0, sample / max(1, n)), 5))
    inside = durable(model.transform(v).select("vec_id", "embedding", F.col("prediction").alias("list")))
    centres = np.array(model.clusterCenters())

    @F.pandas_udf("array<int>")
    def nearest(q: pd.Series) -> pd.Series:
        order = np.argsort(distances(centres, np.stack(q.to_numpy()).astype(float), "l2"), axis=1, kind="stable")
        return pd.Series(list(order.astype(np.int32)))

    asked = durable(queries.where("query_id IS NOT NULL AND query IS NOT NULL").withColumn("lists", nearest(F.col("query").cast("array<double>"))))
    n_asked = asked.count()
    if probes is None:
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, n_asked // trial))) == 0)
        exact = similar(vectors, some, k, "l2").join(inside.select("vec_id", "list"), "vec_id").join(some.select("query_id", "lists"), "query_id")
        place = exact.select(F.array_position("lists", F.col("list")).alias("p"))
        probes = int(place.agg(F.percentile("p", aim)).first()[0] or lists)
    sizes = {r["list"]: r["n"] for r in inside.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list
    return _ranked(_probe(inside, asked, sizes, probes, k, n_asked, block, query_block), k)


def _units(sizes: dict[int, int], lists: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first unit of each list and over how many it is spread: small lists share a unit of about ``block`` vectors, a large one has several."""
    first, spread, unit, full = np.zeros(lists, int), np.ones(lists, int), 0, 0
    for i in range(lists):
        n = sizes.get(i, 0)
        if full and full + n > block:
            unit, full = unit + 1, 0
        first[i], spread[i] = unit, max(1, -(-n // block))
        full += n
        if spread[i] > 1:
            unit, full = unit + spread[i], 0
    return first, spread


def _probe(inside: DataFrame, asked: DataFrame, sizes: dict[int, int], probes: int, k: int, n_asked: int, block: int, query_block: int) -> DataFrame:
    """The ``k`` nearest in each unit of lists: a query goes once to a unit that has lists it probes, and there meets the vectors of those alone."""
    lists = 1 + max(sizes, default=0)
    first, spread = _units(sizes, lists, block)
    asks = max(1, -(-n_asked // query_block))

    @F.pandas_udf("array<struct<unit: int, want: array<int>>>")
    def units(probed: pd.Series) -> pd.Series:
        out = []
        for row in probed:
            at: dict[int, list[int]] = {}
            for i in row[:probes]:
                for u in range(first[i], first[i] + spread[i]) if i < lists else ():
                    at.setdefault(int(u), []).append(int(i))
            out.append([{"unit": u, "want": w} for u, w in at.items()])
        return pd.Series(out)

    @F.pandas_udf("int")
    def unit_of(lst: pd.Series, key: pd.Series) -> pd.Series:
        i = lst.to_numpy()
        return pd.Series((first[i] + key.to_numpy() % spread[i]).astype(np.int32))

    def go(q, c):
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        c = c.sort_values("list", kind="stable")
        ids, x, own = c["vec_id"].to_numpy(), np.stack(c["v"].to_numpy()), c["list"].to_numpy()
        names, starts = np.unique(own, return_index=True)
        ends = np.append(starts[1:], len(own))
        asked, y, want = q["query_id"].to_numpy(), np.stack(q["v"].to_numpy()), q["want"].to_numpy()
        found = []
        for s in range(0, len(asked), AT_ONCE):
            some, near = asked[s : s + AT_ONCE], y[s : s + AT_ONCE]
            probed = np.stack([np.isin(names, w) for w in want[s : s + AT_ONCE]])
            d, ok = np.full((len(some), len(ids)), np.inf), np.zeros((len(some), len(ids)), bool)
            for j in range(len(names)):
                rows = np.flatnonzero(probed[:, j])
                if len(rows):
                    d[rows, starts[j] : ends[j]] = distances(x[starts[j] : ends[j]], near[rows], "l2")
                    ok[rows, starts[j] : ends[j]] = True
            i, j = _head(d, ids, some, ok, k)
            found.append((some[i], ids[j], d[i, j]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "distance"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    double = lambda c: F.col(c).cast("array<double>").alias("v")
    left = inside.select("vec_id", double("embedding"), "list", unit_of("list", F.pmod(F.xxhash64("vec_id"), F.lit(2**31))).alias("unit"))
    left = left.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = asked.select("query_id", double("query"), F.pmod(F.xxhash64("query_id", "query"), F.lit(asks)).cast("int").alias("a"), F.inline(units("lists")))
    return right.groupBy("unit", "a").cogroup(left.groupBy("unit", "a")).applyInPandas(go, "query_id long, vec_id long, distance double")


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)``: lower-case runs of letters and digits, counted per document."""
    words = docs.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(key, score)`` of documents with a term of ``query``. Texts are read once; only the query's terms are kept and exchanged."""
    split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # bound once: the list of words is built a single time per document
    of = F.transform(F.array(split), lambda w: F.struct(F.size(w).alias("len"), F.filter(w, lambda x: x.isin(*query)).alias("w")))[0]
    counted = durable(docs.select(key, of.alias("c")).select(key, "c.len", "c.w"))
    stats = counted.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    hits = counted.select(key, "len", F.explode("w").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy(key).agg(F.sum(idf * tf).alias("score"))


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf, df, weight)`` of every term of every text: counts times the logarithm of (documents + 1) / (df + 1), plus 1."""
    tf = tokens(docs, key, text)
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # all of them; reading tf, both sides share one exchange
    n = docs.agg(F.count("*").alias("_docs"))
    weight = F.col("tf") * (F.ln((F.col("_docs") + 1) / (F.col("df") + 1)) + 1)
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", "tf", "df", weight.alias("weight"))


def fuse_rrf(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked heads (key, rank from 1)."""
    parts = [d.select(key, (1 / (F.lit(k) + F.col("rank"))).alias("s")) for d in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("s").alias("score"))


def scaled(d: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within their list, 1 where all are equal."""
    ends = d.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return d.crossJoin(F.broadcast(ends)).withColumn("score", F.when(span > 0, (F.col("score") - F.col("_lo")) / span).otherwise(1.0)).drop("_lo", "_hi")


def fuse_linear(a: DataFrame, b: DataFrame, key: str, alpha: float) -> DataFrame:
    """alpha * a + (1 - alpha) * b over scores scaled to 0..1 within their own list."""
    x, y = scaled(a).select(key, F.col("score").alias("x")), scaled(b).select(key, F.col("score").alias("y"))
    return x.join(y, key, "full").select(key, (alpha * F.coalesce("x", F.lit(0.0)) + (1 - alpha) * F.coalesce("y", F.lit(0.0))).alias("score"))


def fuse_dbsf(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Scores scaled by mean and three deviations of their own list, then added."""

    def scaled(d: DataFrame) -> DataFrame:
        s = d.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"))
        z = (F.col("score") - (F.col("m") - 3 * F.col("sd"))) / (6 * F.col("sd"))
        return d.crossJoin(F.broadcast(s)).select(key, F.when(F.col("sd") > 0, F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0))).otherwise(0.5).alias("s"))

    return scaled(a).unionByName(scaled(b)).groupBy(key).agg(F.sum("s").alias("score"))


def head(scores: DataFrame, key: str, k: int) -> DataFrame:
    top = scores.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def one_hot(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, column, slot, slots)``: the place of a row's value among the different values in order, and how many there are. Null has no slot.

    Values are numbered within ranges of them, so that no task sorts them all.
    """
    values = durable(df.where(F.col(column).isNotNull()).select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = values.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # a row per partition
    total = values.agg(F.count("*").alias("slots"))
    within = values.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(column)))
    slot = within.join(before, "_part").select(column, (F.col("_i") - 1 + F.col("_before")).alias("slot")).crossJoin(F.broadcast(total))
    return df.select(key, column).join(slot, column, "left").select(key, column, "slot", "slots")


def fuzzy(words: DataFrame, column: str, query: str, most: int = 2) -> DataFrame:
    """Rows whose word is within ``most`` edits of ``query``, with ``edits``."""
    near = words.where(F.abs(F.length(column) - len(query)) <= most)  # edits change the length by one at most
    return near.withColumn("edits", F.levenshtein(F.lower(column), F.lit(query.lower()))).where(F.col("edits") <= most)


def rerank(structured: DataFrame, vector: DataFrame, key: str, weight: float) -> DataFrame:
    """The rows of ``structured`` (key, score) by (1 - weight) * their score + weight * that of ``vector`` (0 where it has none)."""
    both = structured.withColumnRenamed("score", "_s").join(vector.withColumnRenamed("score", "_v"), key, "left")
    return both.select(key, ((1 - weight) * F.col("_s") + weight * F.coalesce("_v", F.lit(0.0))).alias("score"))


def count_min(df: DataFrame, column: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """A count-min sketch as rows ``(row, slot, n)``: at most depth * width of them, which add up to merge sketches."""
    slots = F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), column), F.lit(width)).alias("slot")) for i in range(depth)])
    return df.where(F.col(column).isNotNull()).select(F.inline(slots)).groupBy("row", "slot").agg(F.count("*").alias("n"))


def count_min_estimate(sketch: DataFrame, values: DataFrame, column: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """``(column, estimate)``: never below the count, and above it by more than e / width of all rows at most once in e^depth."""
    slots = F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), column), F.lit(width)).alias("slot")) for i in range(depth)])
    asked = values.select(column).distinct().select(column, F.inline(slots))
    return asked.join(F.broadcast(sketch), ["row", "slot"], "left").groupBy(column).agg(F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(0)).alias("estimate"))
