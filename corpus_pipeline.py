"""A corpus in five stages, each over all that the one before kept: language, repeated lines, near-duplicates, secrets, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again for the next. All but the last return the columns of ``documents``; ``n_chars`` follows the text.
Null texts have no language and go in the first stage; empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import langid, lines, nearcopies, packing, secrets
from quarry.llm.tokens import give_back
from quarry.session import shared_dir, trim_driver

ORACLE_SQL = None  # trained models and tokenizers are not SQL; tests hold the stages against brute force


def _same_columns(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the number of characters brought up to date."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter. Ambiguous ones are clean text still and stay."""
    model = langid.train(docs)
    give_back()  # what the sample took of the driver's Python
    trim_driver(spark)
    found = langid.identify(docs, model)
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of three lines or more that an earlier place has."""
    trim_driver(spark)
    return _same_columns(docs, lines.drop_repeated_lines(docs))


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of least doc_id, then least hash of its text, of each group; of equal rows, one. Rows without id stay.

    Groups are of texts that share 0.8 or more of their shingles of five words, compared by their whole sets.
    """
    known = docs.where("doc_id IS NOT NULL")
    found = nearcopies.near_copies(known.select("doc_id", "text"), size=5, least=(4, 5))
    stays = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("r")).select("r.doc_id", F.col("r.node").alias("_node"))
    kept = known.withColumn("_node", F.xxhash64(F.coalesce("text", F.lit("")))).join(stays, ["doc_id", "_node"], "left_semi")
    return kept.dropDuplicates(["doc_id", "_node"]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def secret_scan(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts."""
    return _same_columns(docs, secrets.redact(docs, secrets.scan(docs)))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents in sequences of at most 2048 tokens."""
    trim_driver(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("pack", pack),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
