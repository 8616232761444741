"""Operator 7: best-fit packing of token sequences by bin completion.

A plan needs only how many pieces there are of each length, at most ``capacity`` numbers however large
the corpus. The plan fills a sequence around the longest piece left with an undominated filling and
repeats that pattern as often as the counts allow, which at least halves what is left of some length each time, so
its patterns are few however large the counts. Branch and
bound over those choices, in order of their waste, starts from the best-fit-decreasing plan as incumbent, cuts branches
with more waste than a plan of one sequence less can have, and ends at as few sequences as the tokens need or after ``nodes``
steps (choices opened, and fillings passed over as dominated); ``best_plan`` tells the bound and whether the plan is proven. Spark then numbers the pieces of each length, in parts of bounded
size, and looks the numbers up in the plan. Tokens never move: only (id, piece, length) rows do.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.tokens import ChunkEncoder, text_batches, vocabulary
from quarry.session import durable

Pattern = tuple[tuple[int, ...], int]  # lengths side by side, how many sequences of that kind


def _sums(lengths: list[int], room: int) -> dict[int, int]:
    """For each length, ascending: which sums up to ``room`` its like and shorter ones can make, as bits, whatever their number."""
    out, bits, whole = {}, 1, (1 << room + 1) - 1
    for x in lengths:
        step = x
        while step <= room:
            bits |= bits << step
            step *= 2
        bits &= whole
        out[x] = bits
    return out


def _fillings(want: int, at: int, chosen: tuple[int, ...], lengths: list[int], reach: dict[int, int], left: np.ndarray) -> Iterator[tuple[int, ...]]:
    """``chosen`` with pieces of ``lengths[at]`` or shorter that add up to ``want``. No closure: one would be in a cycle with itself and outlive its use."""
    if want == 0:
        yield chosen
        return
    while at >= 0 and reach[lengths[at]] >> want & 1:
        x = lengths[at]
        if x <= want and chosen.count(x) < left[x]:
            yield from _fillings(want - x, at, (*chosen, x), lengths, reach, left)
        at -= 1


def completions(counts: np.ndarray, longest: int, most_waste: int) -> Iterator[tuple[int, tuple[int, ...] | None]]:
    """``(waste, pieces)``: ``longest`` with every undominated filling of the room beside it, least waste first, longest pieces first on ties.

    A filling is dominated if a piece in stock fits beside it, or in place of a shorter one of its pieces; for such a one pieces are None. No
    filling is left out for their number: they are made as they are asked for, and sums that no pieces can make are not tried.
    """
    room = len(counts) - 1 - longest
    left = counts.copy()
    left[longest] -= 1
    lengths = np.flatnonzero(left[: min(room, longest) + 1]).tolist()
    reach = _sums(lengths, room)
    ways = reach[lengths[-1]] if lengths else 1

    for waste in range(0, min(room, most_waste) + 1):
        if not ways >> (room - waste) & 1:
            continue
        for chosen in _fillings(room - waste, len(lengths) - 1, (), lengths, reach, left):
            if waste:
                rest = [x for x in lengths if chosen.count(x) < left[x]]
                if any(x <= waste or any(c < x <= c + waste for c in set(chosen)) for x in rest):
                    yield waste, None
                    continue
            yield waste, (longest, *chosen)


def best_plan(counts: dict[int, int], capacity: int, nodes: int = 6000, kept: int = 8) -> tuple[list[Pattern], int, bool]:
    """(patterns, least number of sequences there can be, whether no fewer than those found can do).

    Patterns hold exactly ``counts`` pieces of each length (1 to capacity). It is proven if as few as the tokens need were found, or
    if the search ended before ``nodes`` steps without having taken a pattern several times at once. The path is as deep as patterns are
    many and a level's tables take up to a megabyte, so those of the last ``kept`` levels stay in memory, whatever ``kept`` the plan is the same.
    """
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        stock[length] = n
    total = int((stock * np.arange(capacity + 1)).sum())
    least = max(-(-total // capacity), int(stock[capacity // 2 + 1 :].sum()))  # two long ones never share
    several = False

    def take(pattern: tuple[int, ...]) -> int:
        nonlocal several
        lengths, many = np.unique(pattern, return_counts=True)
        m = int((stock[lengths] // many).min())
        stock[lengths] -= m * many
        several |= m > 1
        return m

    def put_back(pattern: tuple[int, ...], m: int) -> None:
        lengths, many = np.unique(pattern, return_counts=True)
        stock[lengths] += m * many

    def best_fit(longest: int) -> tuple[int, ...]:
        """The longest piece that fits, again and again."""
        below = np.maximum.accumulate(np.where(stock > 0, np.arange(len(stock)), 0))
        out, room, x = [longest], capacity - longest, longest
        while x := int(below[min(room, x)]):
            if stock[x] > out.count(x):
                out.append(x)
                room -= x
            else:
                x -= 1  # all of that length are in
        return tuple(out)

    best: list[Pattern] = []
    while stock.any():
        pattern = best_fit(int(np.flatnonzero(stock)[-1]))
        best.append((pattern, take(pattern)))
    used_best = sum(m for _, m in best)
    for p, m in best:
        put_back(p, m)
    path: list[tuple[Pattern, int, int, int, int]] = []  # what was taken, sequences and waste before it, choices tried, waste allowed
    alive: deque[Iterator] = deque(maxlen=kept)  # the choices left at the last levels of the path; others are made again if the search comes back
    used, waste, steps, several = 0, 0, 0, False
    choices: Iterator | None = None
    tried = spare = 0
    while used_best > least and steps < nodes:
        if choices is None:
            tried = 0
            spare = (used_best - 1) * capacity - total - waste  # waste that a better plan may still have
            if not stock.any():
                if used < used_best:
                    best, used_best = [p for p, *_ in path], used
                choices = iter(())
            elif spare < 0:
                choices = iter(())
            else:
                longest = int(np.flatnonzero(stock)[-1])
                choices = completions(stock, longest, spare)
                steps += 1
        nxt = next(choices, None)
        if nxt is None:
            if not path:
                return best, least, used_best == least or not several
            (pattern, m), used, waste, tried, spare = path.pop()
            put_back(pattern, m)
            if alive:
                choices = alive.pop()
            else:
                choices = completions(stock, pattern[0], spare)
                for _ in range(tried):
                    next(choices)
            continue
        tried += 1
        w, pattern = nxt
        if pattern is None:
            steps += 1
            continue
        m = take(pattern)
        path.append(((pattern, m), used, waste, tried, spare))
        alive.append(choices)
        used, waste, choices = used + m, waste + m * w, None
    return best, least, used_best == least


def plan(counts: dict[int, int], capacity: int, nodes: int = 6000) -> list[Pattern]:
    """Patterns for ``counts`` pieces of each length, in as few sequences as ``best_plan`` finds."""
    return best_plan(counts, capacity, nodes)[0]


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Whole texts to ``(doc_id, piece, start, length, ids)``; ``ids`` little-endian unsigned 32-bit.

    A document is its ids and ``end_id``; null and empty texts are the end id alone. Longer ones than
    ``capacity`` are cut into full pieces, of which the first may be shorter. Each row of a repeated
    doc_id is cut by itself. Other columns are ignored.
    """
    path, end = tokenizer or vocabulary(), np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        with ChunkEncoder.of(path) as encoder:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for span, texts in text_batches(batch.column(1)):
                    rows: list[tuple] = []
                    for i, ids in zip(span, encoder.encode(texts), strict=True):
                        ids += end
                        n = len(ids) // 4
                        a, b, piece = 0, n % capacity or min(n, capacity), 0
                        while a < n:
                            rows.append((keys[i], piece, a, b - a, ids[4 * a : 4 * b]))
                            a, b, piece = b, b + capacity, piece + 1
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary"
    )


def place(pieces: DataFrame, capacity: int = 2048, nodes: int = 6000, part_rows: int = 1000, most_parts: int = 50_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` must give the same rows each time it is read (see ``durable``). The driver gets a count per
    length. Pieces that fill a sequence alone get negative ids where they lie. The others are numbered
    within their length in parts of about ``part_rows``, so that a common length is no one task's load; there are at most
    about ``most_parts`` in all, larger ones where rows are many, so the broadcast tables hold at most
    capacity + most_parts rows, and a row per slot of a pattern.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    alone = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = {k: n for k, n in counts.items() if k < capacity}
    slots, base, seen = [], 0, dict.fromkeys(rest, 0)
    for pattern, m in plan(rest, capacity, nodes) if rest else []:
        offset = 0
        for length in pattern:
            slots.append((length, seen[length], seen[length] + m, base - seen[length], offset))
            seen[length] += m
            offset += length
        base += m
    slots_df = spark.createDataFrame(slots, "length long, low long, high long, shift long, offset long")
    part_rows = max(part_rows, -(-sum(rest.values()) // most_parts))
    parts = spark.createDataFrame([(k, -(-n // part_rows)) for k, n in rest.items()], "length long, parts long")
    salted = (
        pieces.where(F.col("length") < capacity)
        .join(F.broadcast(parts), "length")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start"), "parts"))
        .drop("parts")
    )
    sizes = salted.groupBy("length", "part").count()
    before = sizes.select(
        "length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before")
    )
    ranked = (
        salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")))
        .join(F.broadcast(before), ["length", "part"])
        .withColumn("n", F.col("n") - 1 + F.col("before"))
    )
    s = F.broadcast(slots_df).alias("s")
    r = ranked.alias("r")
    packed = r.join(s, F.expr("r.length = s.length AND r.n >= s.low AND r.n < s.high")).select(
        *[f"r.{c}" for c in pieces.columns], (F.col("r.n") + F.col("s.shift")).alias("sequence_id"), F.col("s.offset")
    )
    return alone.unionByName(packed)


def sequences(placed: DataFrame) -> DataFrame:
    """Placed pieces with their ``ids`` -> ``(sequence_id, ids)``; a group holds at most one sequence."""
    return (
        placed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
        .select("sequence_id", F.expr("aggregate(p, CAST('' AS BINARY), (a, x) -> concat(a, x.ids))").alias("ids"))
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Cut, plan and place whole documents; ``ids_crc32`` is taken from the ids, which stay if asked for."""
    cut = tokenize_pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return place(durable(cut if with_ids else cut.drop("ids")), capacity)


def op7_best_fit_packing(spark, sf_dir) -> DataFrame:
    """All documents in sequences of at most 2048 tokens of the 50k byte-level vocabulary."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
