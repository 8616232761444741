"""Operator 4: repeated passages by overlapping windows of three lines, in DataFrame operations alone.

Lines are what lies between line feeds. Three consecutive lines that are not all empty are a window, known by two 64-bit
hashes of its lines. The first occurrence of a window is the least by (doc_id, line, hash of the text); every line that a
later occurrence covers is removed, overlapping occurrences being merged to stretches first.

A window in very many documents costs one row per occurrence: its first place is found by a partial aggregate, and
the join back is one whose hot keys AQE splits. Documents of fewer than three lines stay as they are. Null text
stays null, null ids come first. Rows of equal doc_id and text are one document and keep the same lines; rows of
one doc_id and different texts are told apart by the text's hash. No rows: no rows. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _occurrences(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.xxhash64("text").alias("_t"), F.split("text", "\n").alias("_l")).where(F.size("_l") > 2)
    at = lambda i, k: F.element_at("_l", (i + k).cast("int"))
    window = F.transform(
        F.sequence(F.lit(0), F.size("_l") - 3),
        lambda i: F.struct(
            i.alias("line"),
            F.xxhash64(at(i, 1), at(i, 2), at(i, 3)).alias("h1"),
            F.xxhash64(F.lit(1), at(i, 3), at(i, 2), at(i, 1)).alias("h2"),
            (F.length(at(i, 1)) + F.length(at(i, 2)) + F.length(at(i, 3))).alias("chars"),
        ),
    )
    return lines.select("doc_id", "_t", F.inline(window)).where("chars > 0").drop("chars")


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """``(doc_id, _t, _cut)`` of documents with later occurrences; ``_cut`` are stretches of lines [from, to), merged."""
    seen = _occurrences(docs)
    place = F.struct("doc_id", "line", "_t")
    first = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = seen.join(first, ["h1", "h2"]).where(place > F.col("first"))
    starts = later.groupBy("doc_id", "_t").agg(F.sort_array(F.collect_set("line")).alias("s"))
    # a stretch begins where the window before does not reach, and ends three lines after its last window
    begins = F.filter("s", lambda x, i: (i == 0) | (F.element_at("s", F.greatest(i, F.lit(1)).cast("int")) < x - 3))
    ends = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.element_at("s", F.least(i + 2, F.size("s")).cast("int")) > x + 3))
    return starts.select("doc_id", "_t", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), (b + 3).alias("b"))).alias("_cut"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its repeated lines gone, and ``n_lines, n_removed``; columns of those names are replaced."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    cut = repeated_stretches(docs).withColumnRenamed("doc_id", "_id").withColumnRenamed("_t", "_h")
    # the other columns as one, so that none of their names meets a name here
    others = F.struct(F.lit(0).alias("_" * (1 + max(map(len, own)))), *[F.col(f"`{c}`") for c in own if c not in ("doc_id", "text")])
    d = docs.select(others.alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_t"))
    joined = d.join(cut, d["doc_id"].eqNullSafe(cut["_id"]) & (d["_t"] == cut["_h"]), "left").withColumn("_l", F.split("text", "\n"))
    keep = F.filter("_l", lambda x, i: ~F.exists("_cut", lambda s: (i >= s["a"]) & (i < s["b"])))
    removed = F.aggregate("_cut", F.lit(0), lambda n, s: n + s["b"] - s["a"])
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    return joined.select(
        *[(text if c == "text" else F.col(c) if c == "doc_id" else F.col("_row").getField(c)).alias(c) for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_l")).alias("n_lines"),
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
    )


def op4_line_dedup(spark, sf_dir) -> DataFrame:
    """All documents without the passages that an earlier place has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def oracle(source: str = "documents") -> str:
    """The same over lines instead of hashes, for a table of documents."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, text, string_split(text, chr(10)) AS l FROM (SELECT DISTINCT doc_id, text FROM {source})),
         w AS (SELECT k, doc_id, i, l[i + 1] AS a, l[i + 2] AS b, l[i + 3] AS c
               FROM (SELECT k, doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM d WHERE len(l) > 2)),
         r AS (SELECT k, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, i) AS place FROM w WHERE a || b || c <> ''),
         g AS (SELECT DISTINCT k, i + j AS i FROM r, range(3) AS t(j) WHERE place > 1),
         n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
         s AS (SELECT k, i, l[i + 1] AS line FROM (SELECT k, l, unnest(range(0, len(l))) AS i FROM d WHERE k IN (SELECT k FROM n))),
         o AS (SELECT s.k, string_agg(line, chr(10) ORDER BY s.i) AS text
               FROM s LEFT JOIN g ON s.k = g.k AND s.i = g.i WHERE g.i IS NULL GROUP BY s.k)
    SELECT x.doc_id, CAST(coalesce(len(d.l), 0) AS INTEGER) AS n_lines, CAST(coalesce(n.n, 0) AS INTEGER) AS n_removed,
           CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(o.text, '') END AS text
    FROM {source} x JOIN d ON x.doc_id IS NOT DISTINCT FROM d.doc_id AND x.text IS NOT DISTINCT FROM d.text
    LEFT JOIN n ON d.k = n.k LEFT JOIN o ON d.k = o.k
    """
