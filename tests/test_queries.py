"""Every registered query with an oracle against DuckDB; the others must run and give rows."""

import math
import re

import duckdb
import pytest

from quarry.plans.catalogue import REGISTRY
from quarry.session import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, duck, name):
    df = REGISTRY.queries[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in REGISTRY.oracles:
        assert rows
        return
    rel = duck.sql(REGISTRY.oracles[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = [tuple(plain(r[rel.columns.index(c)]) for c in sorted(rel.columns)) for r in rel.limit(10**9).fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_tables_are_read():
    """Each query's oracle names an input table."""
    assert all(re.search("|".join(TABLES), s) for s in REGISTRY.oracles.values())
