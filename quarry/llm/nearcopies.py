"""Operator 3 by exact likeness: texts whose sets of word shingles share (Jaccard) ``least`` of their union or more.

SimHash fingerprints and the anchors of ``simhash`` come first: what lies within three bits is linked, each such pair is
compared by its whole sets, and what holds makes classes. That joins all but a few of a large group of near copies at a cost of
one comparison a text. Texts of 0.8 likeness differ in about 10 bits of 64, though, so fingerprints alone miss many.

A prefix filter finds the rest: all shingles have one order, rarest first. Of a set of n, two sets that share ``least`` of
their union both hold one of the first n - ceil(least * n) + 1 of either. So each text goes to those shingles alone, and is
compared beside one shingle with texts of its size over ``least`` at most, by a 128-bit SimHash of its set first: sets of 0.8 likeness
differ in 19 of those bits give or take 4, unrelated ones in about 60, and ``BITS`` parts them (a pair of just 0.8 is lost once in a
million; small sets are not judged so). What is left, and what met at an anchor, directly or through others, is a group of
candidates; in each, all pairs of different classes are compared by their whole sets. The order is of counts in a
sample; a worse one makes more comparisons, never another result.

A shingle's texts, and a group's, are dealt to units of bounded rows and characters: every text outside a group's largest
class meets all others in one. A unit yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.groups import forest, groups, units
from quarry.llm.tokens import give_back, in_batches
from quarry.operators.components import connected_components
from quarry.session import durable, trim_driver

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose shingles a task holds at a time, beside one text at least.
CHARS = 400_000
#: Most differing bits of 128 for which sets are compared whole, where both have ``FEW`` shingles or more.
BITS, FEW = 38, 48


def shingles_of(texts: list[str], size: int) -> list[np.ndarray]:
    """The different 64-bit hashes of each text's shingles of ``size`` words, ascending; a shorter text is one shingle, an empty one too."""
    from xxhash import xxh64_intdigest

    split = [t.encode().lower().split() for t in texts]  # on bytes: A-Z alone, and the six ASCII white-space bytes
    ends = np.cumsum([len(w) for w in split])
    of_word = np.array([xxh64_intdigest(w, 42) for words in split for w in words], dtype=np.uint64)
    h = of_word[: max(0, len(of_word) - size + 1)].copy()
    for k in range(1, size):
        h ^= h >> np.uint64(31)
        h = h * _ODD + of_word[k : len(h) + k]
    h ^= h >> np.uint64(29)
    return [np.unique(h[b - len(w) : b - size + 1]) if len(w) >= size else np.array([xxh64_intdigest(b" ".join(w), 42)], np.uint64) for w, b in zip(split, ends.tolist(), strict=True)]


def _arrow(docs: DataFrame, size: int, schema: str, of) -> DataFrame:
    """``of`` (shingles of some rows, their first column) -> columns of ``schema``; ``docs`` are (node, text), a node once a task."""

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        met: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            new = [i for i, n in enumerate(nodes) if not (n in met or met.add(n))]
            some = batch.take(pa.array(new, pa.int64()))
            texts = some.column(1).to_pylist()
            for span in in_batches(texts, CHARS):
                cols = of(shingles_of(texts[span.start : span.stop], size), some.column(0).slice(span.start, len(span)).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))
        give_back()

    return docs.select("node", "text").mapInArrow(go, schema)


def _common(texts: DataFrame, size: int, one_in: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, counts): those that stand in several of the sampled texts, the ``most`` commonest."""
    some = texts.where(F.pmod("node", F.lit(one_in)) == 0)
    each = _arrow(some, size, "shingle long", lambda sets, _: {"shingle": np.concatenate(sets).view(np.int64)})
    top = each.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(most).toArrow()
    hashes, counts = (top[c].to_numpy().astype(np.int64) for c in ("shingle", "count"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order].astype(np.int32)


def set_marks(s: np.ndarray) -> tuple[int, int]:
    """SimHash of a set of hashes, 128 bits as two signed numbers."""
    out = []
    for h in (s, simhash._mixed(s, 1)):
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > len(s)).view(np.int64)[0]))
    return out[0], out[1]


def _prefixes(texts: DataFrame, size: int, num: int, den: int, common) -> DataFrame:
    """``(shingle, node, n, a, b)``: the rarest shingles of each text, as many as it must share one of; its size and marks."""

    def of(sets, nodes):
        hashes, counts = common.value
        first = []
        for s in sets:
            at = np.searchsorted(hashes, s)
            known = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == s) if len(hashes) else np.zeros(len(s), bool)
            order = np.lexsort((s, np.where(known, counts[np.minimum(at, len(hashes) - 1)], 0) if len(hashes) else s))
            first.append(s[order[: len(s) + (-num * len(s)) // den + 1]])
        long = [len(f) for f in first]
        marks = np.array([set_marks(s) for s in sets], np.int64).reshape(-1, 2)
        each = {"node": nodes, "n": np.array([len(s) for s in sets], np.int32), "a": marks[:, 0], "b": marks[:, 1]}
        return {"shingle": np.concatenate(first).view(np.int64)} | {k: np.repeat(v, long) for k, v in each.items()}

    return _arrow(texts, size, "shingle long, node long, n int, a long, b long", of)


def _met(prefixes: DataFrame, num: int, den: int, most: int = 1024) -> DataFrame:
    """``(src, dst)``: a spanning forest, beside each shingle, of the pairs that size and marks allow to be alike."""

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for t, spans in groups(batches, ["shingle", "low", "high"]):
            node, n = t["node"].to_numpy(), t["n"].to_numpy()
            a, b = (t[c].to_numpy().view(np.uint64) for c in ("a", "b"))

            def near(x, y):
                bits = np.bitwise_count(a[x] ^ a[y]).astype(np.int16) + np.bitwise_count(b[x] ^ b[y])
                small, large = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y])
                return ((bits <= BITS) | (small < FEW)) & (den * small >= num * large) & (node[x] != node[y])

            at = np.array([lo for lo, hi in spans if hi - lo == 2], dtype=np.int64)
            two = at[near(at, at + 1)]
            src, dst = [node[two]], [node[two + 1]]
            for lo, hi in spans:
                if hi - lo > 2:
                    i = np.arange(lo, hi)
                    grid = near(i[:, None], i[None, :])
                    if grid.any():
                        pairs = np.array(forest(grid), dtype=np.int64).reshape(-1, 2) + lo
                        src.append(node[pairs[:, 0]])
                        dst.append(node[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return units(prefixes.withColumn("home", F.lit(True)), ["shingle"], "node", most).mapInArrow(go, "src long, dst long")


def alike(sets: list[np.ndarray], num: int, den: int, width: int = 2048) -> np.ndarray:
    """Which pairs of sets share ``num / den`` of their union or more."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), n)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at]  # what only one has is shared with none
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)  # exact: a set has under 2^24 shingles in a text of 100 MB
    for low in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[row[a:b], column[a:b] - low] = 1
        shared += block @ block.T
    np.fill_diagonal(shared, n)
    return (den + num) * shared.astype(np.int64) >= num * (n[:, None] + n[None, :])


def anchored(texts: DataFrame, size: int) -> DataFrame:
    """``(src, dst)``: pairs of nodes that fingerprints within three bits join, one a node or so."""
    marks = simhash.fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), size)
    marks = durable(marks.select(F.col("doc_id").alias("node"), F.col("fps")[0].alias("fp")).distinct())
    first = durable(marks.groupBy("fp").agg(F.min("node").alias("first")))
    same = marks.join(first, "fp").where("node <> first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    return simhash.links(first.select(F.col("first").alias("node"), "fp")).unionByName(same)


def proven(pairs: DataFrame, held: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose texts in ``held`` (node, text) are alike by their whole sets."""

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for span in in_batches([x + y for x, y in zip(a, b, strict=True)], CHARS):
                sets = shingles_of([x for i in span for x in (a[i], b[i])], size)
                n = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in zip(sets[::2], sets[1::2], strict=True)]
                keep = pa.array([(den + num) * both >= num * all_of for both, all_of in n], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(span.start, len(span)).filter(keep) for i in (0, 1)], names=["src", "dst"])
        give_back()

    of = lambda end, name: held.select(F.col("node").alias(end), F.col("text").alias(name))
    return pairs.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("src", "dst", "a", "b").mapInArrow(go, "src long, dst long")


def _dealt(members: DataFrame, most: int, most_chars: int) -> DataFrame:
    """Rows of ``members`` (node, component, class, text) in units ``(component, part, other)`` such that every two rows of
    different classes of one component meet: a row outside the largest class as ``asks`` in all parts, every row as one asked in all others.
    """
    by_class = members.groupBy("component", "class").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    sizes = by_class.groupBy("component").agg(F.count("*").alias("classes"), F.max_by("class", F.struct("n", "class")).alias("largest"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max(F.struct("n", "class", "chars")).alias("top"))
    need = lambda n, chars: F.greatest(F.ceil(n / F.lit(most)), F.ceil(chars / F.lit(most_chars))).cast("int")
    sizes = sizes.where("classes > 1").select("component", "largest", need(F.col("n"), F.col("chars")).alias("parts"), need(F.col("n") - F.col("top.n"), F.col("chars") - F.col("top.chars")).alias("others"))
    rows = members.join(sizes, "component")
    part, other = F.pmod(F.xxhash64("node"), "parts").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "others").cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.select("*", part.alias("part"), upto("others").alias("other"), F.lit(False).alias("asks"))
    asks = rows.where(F.col("class") != F.col("largest")).select("*", upto("parts").alias("part"), other.alias("other"), F.lit(True).alias("asks"))
    by = ["component", "part", "other"]
    return asked.unionByName(asks).select(*by, "node", "class", "asks", "text").repartition(*by).sortWithinPartitions(*by)


def links(members: DataFrame, size: int, num: int, den: int, most: int = 512, most_chars: int = 2_000_000) -> DataFrame:
    """Spanning links ``(src, dst)`` between alike nodes of one component and different classes."""

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for t, spans in groups(batches, ["component", "part", "other"]):
            node, kind, asks, src, dst = t["node"].to_numpy(), t["class"].to_numpy(), t["asks"].to_numpy(), [], []
            for a, b in spans:
                s = slice(a, b)
                if asks[s].all() or not asks[s].any():
                    continue
                near = alike(shingles_of(t["text"].slice(a, b - a).to_pylist(), size), num, den)
                near &= (asks[s, None] != asks[None, s]) & (kind[s, None] != kind[None, s])
                pairs = np.array(forest(near), dtype=np.int64).reshape(-1, 2) + a
                src.append(node[pairs[:, 0]])
                dst.append(node[pairs[:, 1]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])
        give_back()

    return _dealt(members, most, most_chars).mapInArrow(go, "src long, dst long")


def near_copies(docs: DataFrame, size: int = 5, least: tuple[int, int] = (4, 5), one_in: int = 8, most: int = 1_000_000) -> DataFrame:
    """``(doc_id, node, component_id)`` per row of ``docs`` (doc_id, text); ``node`` is a hash of the text, ``component_id`` the least one of its group.

    Equal texts are one node, whatever their doc_id; a repeated doc_id links nothing. Null is as empty.
    ``one_in`` and ``most`` set what is known of counts, for speed alone.
    """
    num, den = least
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    near = durable(anchored(texts, size))
    trim_driver(docs.sparkSession)
    common = docs.sparkSession.sparkContext.broadcast(_common(texts, size, one_in, most))
    met = _met(_prefixes(texts, size, num, den, common), num, den)
    group = durable(connected_components(near.unionByName(met)))
    trim_driver(docs.sparkSession)
    # one of equal texts, chosen before the exchange, so that many copies are no task's load
    held = durable(texts.groupBy("node").agg(F.first("text").alias("text")).join(group, "node").select("node", "component", "text"))
    sure = durable(proven(near, held, size, num, den))
    class_of = connected_components(sure).withColumnRenamed("component", "class")
    trim_driver(docs.sparkSession)
    members = held.join(class_of, "node", "left").withColumn("class", F.coalesce("class", "node"))
    of_node = connected_components(sure.unionByName(links(members, size, num, den)))
    trim_driver(docs.sparkSession)
    return texts.select("doc_id", "node").join(of_node, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component_id"))
