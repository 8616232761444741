import random

import duckdb

from quarry.llm.lines import drop_repeated_lines, op4_line_dedup, oracle
from tests.llm.oracle import same


def brute(docs):
    first, cut = {}, {}
    for key, text in sorted(docs.items()):
        lines = text.split("\n")
        cut[key] = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if "".join(w) and first.setdefault(w, (key, i)) != (key, i):
                cut[key] |= {i, i + 1, i + 2}
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut[k]) for k, t in docs.items()}


def test_sql(spark):
    assert same(spark, op4_line_dedup, oracle()) == 1000


def test_against_brute_force(spark):
    rng = random.Random(8)
    docs = {i: "\n".join(rng.choices(["a", "b", "", "c c"], k=rng.randint(1, 25))) for i in range(120)}
    df = spark.createDataFrame([(k, t) for k, t in docs.items()], "doc_id long, text string")
    assert {r.doc_id: r.text for r in drop_repeated_lines(df).collect()} == brute(docs)


def test_odd_rows(spark):
    long = "\n".join(f"line {i % 700}" for i in range(5000))
    rows = [(None, "a\nb\nc", 1), (1, None, 2), (2, "", 3), (3, "x\na\nb\nc\ny", 4), (4, long, 5), (5, "p\nq\nr", 6), (5, "p\nq\nr", 7), (5, "p\nq\nr\ns", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int").withColumnRenamed("n_lines", "h1")
    got = {(r.doc_id, r.h1): (r.text, r.n_removed) for r in drop_repeated_lines(df).collect()}
    assert got[(None, 1)] == ("a\nb\nc", 0) and got[(1, 2)] == (None, 0) and got[(2, 3)] == ("", 0)
    assert got[(3, 4)] == ("x\ny", 3)
    # equal rows keep the same lines; of one id's two texts, the one of larger hash repeats the other
    assert got[(5, 6)] == got[(5, 7)] and sorted([got[(5, 6)][1], got[(5, None)][1]]) == [0, 3]
    assert got[(4, 5)] == ("\n".join(f"line {i}" for i in range(700)), 4300)
    assert drop_repeated_lines(df.limit(0)).count() == 0


def test_clashing_names_and_equal_rows(spark):
    names = ["_t", "_cut", "_l", "_id", "_h", "_row", "h1", "first", "line", "a.b"]
    rows = [(k, t, *[f"{n}{k}" for n in names]) for k, t in [(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, "x"), (2, "a\nb\nc\nd"), (4, "e\ne\ne\ne")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a\nb\nc"), (2, "d"), (2, "d"), (3, "x"), (4, "e")]
    assert all(r[2 + i] == f"{n}{r.doc_id}" for r in got.collect() for i, n in enumerate(names))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'a\nb\nc'), (2, 'a\nb\nc\nd'), (3, 'x'), (2, 'a\nb\nc\nd'), (4, 'e\ne\ne\ne'), (NULL, 'a\nb\nc'), (5, NULL)) v(doc_id, text)".replace("\n", "' || chr(10) || '"))
    want = sorted(con.sql(oracle()).fetchall(), key=str)
    rows = [(r[0], r[1]) for r in con.sql("SELECT * FROM documents").fetchall()]
    have = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text")
    assert sorted((tuple(r) for r in have.collect()), key=str) == want
