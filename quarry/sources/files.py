"""Sources and sinks by format, each with the options its text form needs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir

#: An empty field is null, a quoted empty one is an empty text. The reader takes an unquoted empty field for its mark
#: of null, whatever that is, so the mark is one that no empty text equals.
CSV = {"header": "true", "escape": '"', "multiLine": "true"}
CSV_WRITE = CSV | {"nullValue": ""}
CSV_READ = CSV | {"nullValue": "\\N"}


def write(df: DataFrame, kind: str, partition_by: list[str] | None = None, **options: str) -> str:
    """Write to a new shared folder and return it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    writer = df.write.options(**CSV_WRITE) if kind == "csv" else df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).options(**options).format(kind).save(path)
    return path


def read(spark: SparkSession, kind: str, path: str, schema, **options: str) -> DataFrame:
    """Read with a schema: nothing is inferred, so nothing is read twice. Options of the format may be added (``sep``, ``quote``, ``nullValue``)."""
    reader = spark.read.schema(schema)
    return (reader.options(**CSV_READ) if kind == "csv" else reader).options(**options).format(kind).load(path)


def round_trip(df: DataFrame, kind: str, **options: str) -> DataFrame:
    return read(df.sparkSession, kind, write(df, kind, **options), df.schema, **options)


def chunked(df: DataFrame, ts: str, unit: str = "MONTH") -> DataFrame:
    """Written in one folder per chunk of time and read back: a filter on ``chunk`` prunes folders."""
    spark = df.sparkSession
    path = write(df.withColumn("chunk", F.to_date(F.date_trunc(unit, ts))), "parquet", ["chunk"])
    return spark.read.parquet(path)


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of the named tables: its type and place, and how many rows the table and nulls the column has. One pass a table."""
    parts = []
    for name, df in tables.items():
        each = [F.struct(F.lit(name).alias("collection"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(i).alias("position"), F.count("*").alias("rows"), (F.count("*") - F.count(F.col(f"`{f.name}`"))).alias("nulls")) for i, f in enumerate(df.schema.fields)]
        parts.append(df.agg(F.array(*each).alias("c")).select(F.inline("c")))
    return reduce(DataFrame.unionByName, parts)


class MaterializedView:
    """A query's rows in a folder of their own for each refresh. Readers see the last refresh that was written whole."""

    def __init__(self, spark: SparkSession, folder: str, shape: Callable[[], DataFrame]) -> None:
        self.spark, self.folder, self.shape = spark, folder.rstrip("/"), shape

    def _whole(self) -> list[str]:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = fs.listStatus(base) if fs.exists(base) else []
        return sorted(f.getPath().getName() for f in there if fs.exists(f.getPath().suffix("/_SUCCESS")))

    def refresh(self) -> None:
        """Writes the query's rows as they are now; the folder counts once Spark has marked it complete."""
        n = len(self._whole())
        self.shape().write.mode("overwrite").parquet(f"{self.folder}/refresh-{n:09d}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._whole()[-1]}")
