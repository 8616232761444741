import datetime
import random

from quarry.operators import timeseries as ts


def at(seconds):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=seconds)


def test_increases_against_a_plain_loop(spark):
    rng = random.Random(4)
    times = {s: sorted(rng.sample(range(0, 900_000), 60)) for s in ("a", "b")}
    rows = [(s, at(t), rng.choice([None, float(rng.randrange(50))]) if i % 9 == 0 else float(rng.randrange(50))) for s, of in times.items() for i, t in enumerate(of)]
    df = spark.createDataFrame([*rows, ("a", None, 3.0), (None, at(5), 1.0), (None, at(9), 4.0)], "s string, t timestamp, v double")
    for seconds in (86_400, 5_000, 10**8):
        got = {(r.s, r.t.timestamp()): (r.delta, r.seconds) for r in ts.increases(df, ["s"], "t", "v", seconds).collect()}
        assert len(got) == 122 and got[None, at(9).timestamp()] == (3.0, 4.0)
        for s in times:
            own = [r for r in rows if r[0] == s]
            for before, now in zip([None, *own], own, strict=False):
                b = before and before[2]
                delta = None if before is None or b is None else None if now[2] is None else now[2] - b if now[2] >= b else now[2]
                if now[2] is None and b is not None:
                    delta = None
                seconds_ = None if before is None else (now[1] - before[1]).total_seconds()
                assert got[s, now[1].timestamp()] == (delta, seconds_)


def test_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 5.0), (4, None)], "k int, s double")
    assert [ts.rank_of(df, "s", "k", k).collect() for k in (9,)] == [[]]
    assert [ts.rank_of(df, "s", "k", k).first().rank for k in (2, 1, 3)] == [1, 2, 3]


def test_sessions_of_one_busy_actor(spark):
    rows = [(i, 1, None if i == 3 else at(t)) for i, t in enumerate([0, 10, 1811, 0, 4000])]
    got = {r.e: r.session_start and r.session_start.timestamp() - at(0).timestamp() for r in ts.sessionize(spark.createDataFrame(rows, "e int, u int, t timestamp"), "u", "t", 1800, "e").collect()}
    assert got == {0: 0, 1: 0, 2: 1811, 4: 4000, 3: 4000}


def test_continuous_aggregate_keeps_its_place(spark, tmp_path):
    rows = [(at(t), v) for t, v in ((0, 1.0), (200, 3.0), (310, 5.0), (620, float("nan")), (630, 7.0), (1500, 9.0))]
    df = spark.createDataFrame(rows, "t timestamp, v double")
    start = int(at(0).timestamp())
    a = ts.ContinuousAggregate(spark, f"{tmp_path}/agg", "t", "v", 300, 60, start, max_interval=600)
    assert a.upto() == start and a.refresh(df, start + 359) == start and a.refresh(df, start + 700) == start + 600
    late = df.union(spark.createDataFrame([(at(100), 100.0)], df.schema))
    assert a.refresh(late, start + 5000) == start + 1200  # at most 600 further
    again = ts.ContinuousAggregate(spark, f"{tmp_path}/agg", "t", "v", 300, 60, start)
    assert again.upto() == start + 1200 and again.refresh(late, start + 2000) == start + 1800
    got = {r.bucket.timestamp() - start: (r.sum, r.n, r.avg) for r in again.read().collect()}
    assert got == {0: (4.0, 2, 2.0), 300: (5.0, 1, 5.0), 600: (7.0, 1, 7.0), 1500: (9.0, 1, 9.0)}


def test_series(spark):
    df = spark.createDataFrame([("a", "x", 1, 2.0), ("ab", "x", 1, 4.0), (None, "y", 1, 0.0), ("b", "y", 2, 5.0)], "j string, k string, t int, v double")
    some = lambda *m: sorted(str(r.j) for r in ts.select_series(df, list(m)).collect())
    assert some(("j", "=~", "a")) == ["a"] and some(("j", "=~", "a.*")) == ["a", "ab"] and some(("j", "!=", "a")) == ["None", "ab", "b"]
    assert some(("j", "=", "")) == ["None"] and some(("j", "!~", "a.*|b")) == ["None"] and some(("k", "=", "x"), ("j", "!~", "ab")) == ["a"]
    a, b = df.where("j = 'b'"), df.where("k = 'y'")
    assert [tuple(r) for r in ts.combine_series(a, b, ["k", "t"], "v", "/").collect()] == [("y", 2, 1.0)]
    assert ts.combine_series(b, b, ["t"], "v", "/").where("t = 1").first().v is None
