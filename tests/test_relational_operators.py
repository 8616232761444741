import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregates, relational, versions
from quarry.plans.relational import R, _within_ten_minutes


def at(seconds):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=seconds)


def test_as_of_against_brute_force(spark):
    rng = random.Random(1)
    key = lambda: rng.choice([None, 1, 1, 1, 2])
    left = [(i, key(), None if rng.random() < 0.1 else at(rng.randrange(0, 400_000, 1000))) for i in range(120)]
    right = {(key(), None if rng.random() < 0.1 else at(rng.randrange(0, 400_000, 1000))): i for i in range(60)}
    a = spark.createDataFrame(left, "id int, k int, t timestamp")
    b = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k int, t timestamp, v int")
    for seconds in (86_400, 3_000, 10_000_000):
        got = {r.id: r.v for r in relational.join_as_of(a, b, "k", "t", ["v"], seconds).collect()}
        want = {}
        for i, k, t in left:
            before = [(s, v) for (j, s), v in right.items() if None not in (k, t, j, s) and j == k and s <= t]
            want[i] = max(before)[1] if before else None
        assert got == want
    assert relational.join_as_of(a, b.limit(0), "k", "t", ["v"]).where("v IS NOT NULL").count() == 0
    assert relational.join_as_of(a.limit(0), b, "k", "t", ["v"]).count() == 0


def test_range_against_brute_force(spark):
    rng = random.Random(2)
    some = lambda: rng.choice([None, 0.0, 10.0, 10.5, 20.0, rng.uniform(-30, 60)])
    ranges, points = [(i, some(), some()) for i in range(60)], [(i, some()) for i in range(60)]
    ranges += [(100, 0.0, 10.5), (101, 5.0, 5.0)]
    points += [(100, 10.2), (100, 10.2)]
    a, b = spark.createDataFrame(ranges, "i int, low double, high double"), spark.createDataFrame(points, "j int, at double")
    want = sorted((i, j) for i, lo, hi in ranges for j, x in points if None not in (lo, hi, x) and lo <= x < hi)
    for width in (10, 0.7, 500):
        assert sorted((r.i, r.j) for r in relational.join_range(a, b, "low", "high", "at", width).collect()) == want


def test_quantified_against_three_valued_logic(spark):
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}
    values = [None, 1, 2, 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    for members in ([], [None], [2], [2, 2], [1, 3], [1, 2, None], [2, None]):
        sub = spark.createDataFrame([(m,) for m in members], "x int")
        for name, op in ops.items():
            for every in (False, True):
                if members not in ([2], [1, 2, None], []) and name in ("<=", ">"):
                    continue  # enough of them
                got = {r.v: r.holds for r in relational.quantified(df, "v", name, sub, "x", every).collect()}
                for v in values:
                    each = [None if v is None or m is None else op(v, m) for m in members]
                    want = (False if False in each else None if None in each else True) if every else (True if True in each else None if None in each else False)
                    assert got[v] == want, (v, name, every, members)


def test_nearest_rank_against_sorting(spark):
    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, -inf, inf, 5.0, 5.0, rng.gauss(0, 100)])) for _ in range(400)] + [(3, 7.0), (4, None), (5, nan), (5, 1.0), (5, inf)]
    df = spark.createDataFrame(rows, "g int, x double")
    quantiles = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}
    for ranges in (256, 3):
        got = {r.g: tuple(str(r[q]) for q in quantiles) for r in aggregates.nearest_rank(df.where("g IS NOT NULL"), ["g"], "x", quantiles, ranges).collect()}
        want = {}
        for g in (1, 2, 3, 5):
            xs = sorted((x for k, x in rows if k == g and x is not None), key=lambda x: (x != x, x))
            want[g] = tuple(str(xs[int(p * (len(xs) - 1) + 0.5)]) for p in quantiles.values())
        assert got == want
    assert aggregates.nearest_rank(df, [], "x", {"m": 1.0}).count() == 1
    assert aggregates.nearest_rank(df.limit(0), ["g"], "x", quantiles).count() == 0


def test_stored_aggregates_are_used_only_if_they_cover(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 2, None)], "a int, b int, v int")
    wrong = spark.createDataFrame([(1, 1, 100)], "a int, b int, n long")  # tells whether it was used
    count, total = {"n": ("count", None)}, {"n": ("count", None), "s": ("sum", "v")}
    assert sorted(aggregates.from_stored(df, [(wrong, ["a", "b"], count)], ["a"], count).collect()) == [(1, 100)]
    assert sorted(map(tuple, aggregates.from_stored(df, [(wrong, ["a", "b"], count)], ["a"], total).collect()), key=str) == [(1, 2, 12), (2, 1, None)]
    assert aggregates.from_stored(df, [(wrong.select("b", "n"), ["b"], count)], ["a"], count).count() == 2


def test_versions(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", None)], "k int, v string, w double")
    asked = spark.createDataFrame([(1, "b", "x"), (2, None, "y"), (9, None, "z")], "k int, expected string, new string")
    assert sorted(tuple(r) for r in versions.compare_and_set(df, "k", "v", asked).select("k", "v", "swapped").collect()) == [(1, "a", False), (2, "y", True), (3, "c", None)]
    new = versions.delete(versions.update(versions.insert(df, spark.createDataFrame([(4, "d"), (4, "e"), (1, "q")], "k int, v string"), "k"), df["k"] == 3, {"w": df["k"] * 1.5}), df["k"] == 1)
    log = {r.k: r for r in versions.change_log(df, new, "k", ["v"]).collect()}
    assert {k: r.op for k, r in log.items()} == {1: "delete", 3: "update", 4: "insert"}
    assert log[3].before.v is None and log[3].before.w is None and log[3].after.w == 4.5 and log[4].before is None
    with pytest.raises(ValueError):
        list(relational.from_any({"a": df}).columns).index("missing")


def test_join_in_parts_deals_a_busy_key(spark):
    left = [(i, None if i % 3 == 0 else i % 3) for i in range(40)] + [(7, 1), (7, 1), (99, 5)]
    right = [(100 + i, None if i % 2 == 0 else 1) for i in range(25)] + [(100, None), (300, 6)]
    a, b = spark.createDataFrame(left, "i int, k int"), spark.createDataFrame(right, "j int, k int")
    want = sorted((i, j) for i, k in left for j, m in right if k == m)
    for rows, part in ((3, 4), (1000, 1000)):
        met = relational.join_in_parts(a, b, "k", rows, part)
        assert sorted((r.i, r.j) for r in met.select("i", "j").collect()) == want
        assert met.columns == ["i", "k", "j", "k"]
    assert sorted((r.i, r.j) for r in relational.join_null_safe(a, b, "k").select("i", "j").collect()) == want
    # one key of 4,096 by 64 rows is more than one task's work
    many = relational.join_in_parts(spark.range(4096).selectExpr("id AS i", "1 AS k"), spark.range(64).selectExpr("id AS j", "1 AS k"), "k", 256, 32).select("i", "j")
    assert many.count() == 4096 * 64 and many.groupBy(F.spark_partition_id()).count().count() > 4


def test_join_in_parts_unfolds_bare_values(spark):
    """No struct is made a pair where the right has one column beside its key; null values stay."""
    a = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "i int, k int")
    for kind in ("k int, j int", "k double, j int"):
        b = spark.createDataFrame([(1, 5), (1, None), (None, None)], ["k", "j"]).selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in kind.split(", ")))
        met = relational.join_in_parts(a, b, "k", 2, 2)
        assert met.columns == ["i", "k", "k", "j"]
        want = [(1, 1, 1, 5), (1, 1, 1, None), (None, 1, 1, 5), (None, 1, 1, None), (2, None, None, None)]
        assert sorted(map(repr, map(tuple, met.toDF("a", "b", "c", "d").selectExpr("a", "b", "CAST(c AS int)", "d").collect()))) == sorted(map(repr, want))
        assert ("explode(_v" in met._jdf.queryExecution().executedPlan().toString()) == ("double" not in kind)


def test_join_in_parts_is_small_when_written(spark, tmp_path):
    """The pairs of a busy key come in an order that columns of values keep small: 6 million pairs took over a byte each."""
    a, b = spark.range(1000).selectExpr("id * 7 AS i", "CAST(NULL AS int) AS k"), spark.range(6000).selectExpr("id * 5 AS j", "CAST(NULL AS int) AS k")
    met = relational.join_null_safe(a, b, "k").select("i", "j")
    met.write.parquet(str(tmp_path / "met"))
    kept = spark.read.parquet(str(tmp_path / "met"))
    assert kept.agg(F.count("*"), F.count_distinct("i", "j"), F.sum("i"), F.sum("j")).first() == (6_000_000, 6_000_000, 999 * 500 * 7 * 6000, 5999 * 3000 * 5 * 1000)
    assert sum(f.stat().st_size for f in (tmp_path / "met").glob("*.parquet")) < 0.25 * 6_000_000


def test_natural_join_is_small_when_written(spark, tmp_path):
    """Nations with many customers and suppliers, few of either, and none known: all pairs, in little space."""
    nation = "CASE WHEN id % 1000 = 1 THEN NULL WHEN id % 1000 = 2 THEN 7 WHEN id % 3 = 0 THEN 5 ELSE 3 END"
    spark.range(1500).selectExpr("id AS c_custkey", f"CAST({nation} AS int) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(9000).selectExpr("id AS s_suppkey", f"CAST({nation} AS int) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    R.queries["join_natural"](spark, str(tmp_path)).write.parquet(str(tmp_path / "met"))
    c, s, met = (spark.read.parquet(str(tmp_path / n)) for n in ("customer.parquet", "supplier.parquet", "met"))
    figures = lambda d: d.agg(F.count("*"), F.sum("c_custkey"), F.sum("s_suppkey"), F.sum(F.xxhash64("c_custkey", "s_suppkey").cast("decimal(38)"))).first()
    assert figures(met) == figures(c.join(s, c["c_nationkey"] == s["s_nationkey"]))
    assert sum(f.stat().st_size for f in (tmp_path / "met").glob("*.parquet")) < 0.25 * met.count()


def test_join_in_parts_goes_by_runs(spark):
    a, b = spark.range(5).selectExpr("id AS i", "1 AS k"), spark.range(40).selectExpr("id AS j", "1 AS k")
    for other, extra in ((b, ()), (b.selectExpr("j", "k", "-j AS l"), ("l",))):  # bare values, and structs
        rows = [(r.i, r.j) for r in relational.join_in_parts(a, other, "k", 100, 100, 16).select("i", "j", *extra).collect()]
        assert sorted(rows) == [(i, j) for i in range(5) for j in range(40)]
        runs = [{j for _, j in rows[n * 80 + m * 16 : n * 80 + (m + 1) * 16]} for n in range(2) for m in range(5)]
        assert all(len(r) == 16 for r in runs) and all(r == runs[5 * (n // 5)] for n, r in enumerate(runs))
        assert [rows[n * 16][0] for n in range(5)] == [rows[80 + n * 16][0] for n in range(5)]
    # keys with few and with many rows, none, and parts beyond their share
    left = spark.range(300).selectExpr("id AS i", "IF(id % 7 = 0, NULL, id % 40) AS k")
    right = spark.range(500).selectExpr("id AS j", "IF(id % 3 = 0, NULL, CAST(sqrt(id) AS int) + 5) AS k").selectExpr("j", "CAST(k AS bigint) AS k")
    want = sorted(map(tuple, left.join(right, left["k"].eqNullSafe(right["k"])).select("i", "j").collect()))
    for sizes in ((8, 12, 4), (50, 7, 3), (16_384, 2_016, 168)):
        for small in (0, 10_000):
            assert sorted(map(tuple, relational.join_in_parts(left, right, "k", *sizes, small=small).select("i", "j").collect())) == want
    assert relational.join_in_parts(left.where("k = 1"), right.where("k = 2"), "k").count() == 0


def test_counts_in_ranges_make_no_pairs(spark):
    rng = random.Random(3)
    ranges = [(i, rng.choice([None, *range(-30, 30)]), rng.choice([None, *range(-30, 60)])) for i in range(60)]
    points = [(rng.choice([None, *range(-40, 70)]),) for _ in range(80)]
    a, b = spark.createDataFrame(ranges, "i int, low long, high long"), spark.createDataFrame(points, "at long")
    want = {i: sum(1 for (x,) in points if None not in (lo, hi, x) and lo <= x < hi) for i, lo, hi in ranges}
    for width in (7, 1000):
        assert {r.i: r.n for r in relational.count_in_range(a, b, "low", "high", "at", width).collect()} == want
    # 100,000 events of one moment would be 10,000 million pairs
    crowd = spark.range(100_000).selectExpr("id AS event_id", "timestamp_seconds(5) AS ts")
    assert _within_ten_minutes(crowd).agg(F.min("n"), F.max("n"), F.count("*")).first() == (99_999, 99_999, 100_000)
    twice = spark.createDataFrame([(1, 0), (1, 10), (2, 20), (3, 5000), (4, None)], "event_id long, s long").selectExpr("event_id", "timestamp_seconds(s) AS ts")
    assert [tuple(r) for r in _within_ten_minutes(twice).collect()] == [(1, 2)]
