"""Updates, merges, versions and change logs as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """All expressions see the row as it was."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def update_first(df: DataFrame, key: str, order: list[Column], n: int, values: dict[str, Column]) -> DataFrame:
    """Updates the first ``n`` rows (a bounded number, which is broadcast) of ``order``; ``key`` tells rows apart."""
    first = df.orderBy(*order).limit(n).select(F.col(key).alias("_first"))
    marked = df.join(F.broadcast(first), df[key] == F.col("_first"), "left")
    return update(marked, F.col("_first").isNotNull(), values).drop("_first")


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is unknown stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of equal key and are added otherwise."""
    return df.join(new, key, "left_anti").unionByName(new)


def as_of(df: DataFrame, key: str, at: str, when: str, tie: str) -> DataFrame:
    """The latest version of each key not later than ``when``, by an aggregate without a sort."""
    old = df.where(F.col(at) <= F.lit(when).cast("timestamp"))
    return old.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(at, tie)).alias("r")).select("r.*")


def changes(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Rows where ``column`` differs from the row before of its key, with ``before`` and ``op``."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = df.withColumn("before", F.lag(column).over(w)).withColumn("op", F.when(F.row_number().over(w) == 1, "insert").otherwise("update"))
    return seen.where(~F.col("before").eqNullSafe(F.col(column)) | (F.col("op") == "insert"))


def retain(df: DataFrame, key: str, at: str, tie: str, most: int, max_age_seconds: int) -> DataFrame:
    """The latest ``most`` rows of each key that are not older than the age, counted back from the latest row of all."""
    last = df.agg(F.max(at).alias("_last"))
    young = df.crossJoin(F.broadcast(last)).where(F.unix_micros(at) >= F.unix_micros("_last") - max_age_seconds * 1_000_000).drop("_last")
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return young.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def compare_and_set(df: DataFrame, key: str, column: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (key, expected, new): the new value where the present one equals the expected (null equals null), else none; ``swapped`` tells.

    Keys that are not there are not added. ``wanted`` has one row per key.
    """
    both = df.join(wanted.select(key, F.col("expected").alias("_e"), F.col("new").alias("_n"), F.lit(True).alias("_asked")), key, "left")
    hit = F.col("_asked").isNotNull() & F.col(column).eqNullSafe(F.col("_e"))
    return both.withColumn("swapped", F.when(F.col("_asked").isNotNull(), hit)).withColumn(column, F.when(hit, F.col("_n")).otherwise(F.col(column))).select(*df.columns, "swapped")


def insert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``df`` and the rows of ``new`` whose key is not there yet, one per key (the least by all columns); columns that ``new`` lacks are null."""
    first = new.groupBy(key).agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")
    return df.unionByName(first.join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def change_log(old: DataFrame, new: DataFrame, key: str, redact: list[str] = ()) -> DataFrame:
    """``(key, op, before, after)`` between two states of a table; ``redact`` columns are null in both. One row per key that changed."""
    cols = [c for c in old.columns if c != key]
    shown = F.struct(*[F.lit(None).cast(old.schema[c].dataType).alias(c) if c in redact else F.col(c) for c in cols])
    plain = F.struct(*cols)
    a = old.select(key, plain.alias("_a"), shown.alias("before"))
    b = new.select(key, plain.alias("_b"), shown.alias("after"))
    op = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").otherwise("update")
    return a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, op.alias("op"), "before", "after")
