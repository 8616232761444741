"""Compare a registered query with its SQL on the small tables."""

import duckdb

from quarry.session import TABLES


def same(spark, query, sql, sf="/root/testdata/sf0.01"):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    want = [tuple(r[rel.columns.index(n)] for n in names) for r in rel.limit(10**9).fetchall()]
    df = query(spark, sf)
    assert sorted(df.columns) == names
    got = [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return len(got)
