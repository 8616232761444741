"""Streaming twins of the time operators: a bounded run over what is there, by checkpointed micro-batches.

In update and append mode state is bounded by the watermark; in complete mode, which session windows that must all be seen
at the end of a bounded run need, all results are state. The sink keeps each trigger's changes and reads the last of each key (update),
replaces its folder each trigger (complete), or appends Parquet files exactly once; all lie in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir, table


def source(spark: SparkSession, sf: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """The files of a table as a stream; zone-less times become times of the session zone."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf}/{name}.parquet*")
    ntz = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else stream


def run(stream: DataFrame, mode: str, keys: list[str] = ()) -> DataFrame:
    """Run a stream over all that is available and read its sink; ``keys`` tell the results of update mode apart."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "complete":
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    elif mode == "update":
        q = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/_batch={i:09d}")).start()  # a repeated batch replaces its own
        q.awaitTermination()
        kept = spark.read.schema(stream.schema.add("_batch", "long")).option("basePath", f"{folder}/out").parquet(f"{folder}/out/_batch=*")
        return kept.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_r")).select("_r.*")
    else:
        q = writer.format("parquet").option("path", f"{folder}/out").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def windows(stream: DataFrame, ts: str, width: str, by: list[str], value: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows with count and sum."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, ts: str, actor: str, gap: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(actor, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(actor, F.col("w.start").alias("start"), "n")


def first_seen(stream: DataFrame, ts: str, key: list[str], within: str) -> DataFrame:
    """Each key once in any stretch of ``within``: keys not seen for longer are forgotten, so state is bounded."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(key).select(*key)


def over(name: str, shape: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] = ()) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: run(shape(source(spark, sf, name)), mode, keys)


def batch(name: str, shape: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The same shape over the table at once."""
    return lambda spark, sf: shape(table(spark, sf, name))
