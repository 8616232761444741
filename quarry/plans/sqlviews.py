"""Spark SQL over the input tables a statement names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quarry.registry import Registry
from quarry.session import TABLES, table

_NAMES = re.compile(rf"\b({'|'.join(TABLES)})\b")


def run_sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    for name in set(_NAMES.findall(text)):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(text)


def stacked_views(spark: SparkSession, views: dict[str, DataFrame | str], query: str) -> DataFrame:
    """Views over views, in order; their predicates meet in one plan."""
    for name, of in views.items():
        (spark.sql(of) if isinstance(of, str) else of).createOrReplaceTempView(name)
    return spark.sql(query)


def adder(registry: Registry):
    """``add(name, spark_sql, oracle=None)``: a statement, with its oracle where the dialects differ."""

    def add(name: str, text: str, oracle: str | None = None) -> None:
        registry.add(name, oracle or text)(lambda spark, sf: run_sql(spark, sf, text))

    return add
