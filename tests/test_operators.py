"""Operators on small tables: nulls, ties, empty tables, clashing names."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom import operators as O
from sparkloom.functions import bucket, extensions, json_int, safe_divide, word_count


def at(minute):
    return None if minute is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


LEFT = "id long, k string, t timestamp_ntz"
RIGHT = "k string, t timestamp_ntz, v string"


def asof_by_hand(left, right):
    out = []
    for i, k, t in left:
        ok = [(u, v is not None, v or "") for q, u, v in right if k is not None and t is not None and q == k and u is not None and u <= t]
        out.append((i, max(ok)[2] if ok and max(ok)[1] else None))
    return sorted(out, key=str)


def test_asof_join(spark):
    left = [(1, "a", at(5)), (2, "a", at(1)), (3, None, at(5)), (4, "b", None), (5, "c", at(9)), (6, "a", at(3))]
    right = [("a", at(3), "x"), ("a", at(3), "y"), ("a", at(4), "z"), (None, at(1), "n"), ("b", None, "q"), ("c", at(10), "w")]
    for split in (None, "2 minutes", "1 day"):
        got = O.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", ["v"], split=split)
        assert sorted(((r.id, r.v_asof) for r in got.collect()), key=str) == asof_by_hand(left, right)
    none = O.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame([], RIGHT), ["k"], "t", ["v"])
    assert none.count() == 6 and none.filter("v_asof is not null").count() == 0


def test_range_join_meets_each_pair_once(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 9.99), (3, 10.0), (4, -3.0), (5, None)], "p long, x double")
    ranges = spark.createDataFrame([("a", 0.0, 10.0), ("b", -5.0, 25.0), ("c", 7.0, 7.0), ("d", None, 3.0)], "r string, lo double, hi double")
    got = sorted((r.p, r.r) for r in O.range_join(points, ranges, "x", "lo", "hi", 4.0).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (4, "b")]


def test_salted_join_is_the_join(spark):
    a = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (None, 8), (3, 9)], "k int, x int")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, O.salted_join(a, b, ["k"], 4, how).collect())) == sorted(map(str, a.join(b, ["k"], how).collect()))


def test_latest_per_key_and_top(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w"), (None, 4, "v")], "k string, t int, v string")
    assert sorted((str(r.k), r.v) for r in O.latest_per_key(df, ["k"], ["t"]).collect()) == [("None", "v"), ("a", "z"), ("b", "w")]
    assert O.latest_per_key(df.limit(0), ["k"], ["t"]).count() == 0
    assert O.top_k_per_group(df, ["k"], [df.t.desc(), df.v], 1).count() == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["u", "w"]), st.integers(0, 200)), min_size=1, max_size=15, unique=True))
def test_sessions_split_at_gaps(spark, rows):
    df = spark.createDataFrame([(u, at(m)) for u, m in rows], "u string, t timestamp_ntz")
    got = {(r.u, r.t): r.session for r in O.sessions(df, "u", "t", "30 minutes").collect()}
    for user in {u for u, _ in rows}:
        times, s = sorted(m for u, m in rows if u == user), 0
        for a, b in zip([None, *times], times):
            s += a is not None and b - a > 30
            assert got[user, at(b)] == s


def test_split_by_time_changes_nothing(spark):
    rnd = random.Random(8)
    when = lambda: at(rnd.choice([None, *range(0, 400, 7), 5000, 9000]))
    left = [(i, rnd.choice(["a", "b", None]), when()) for i in range(120)]
    right = [(rnd.choice(["a", "b", None]), when(), rnd.choice(["x", "y", None])) for _ in range(60)]
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    a = a.withColumn("_Piece", F.lit(1)).withColumn("_before", F.lit(2)).withColumn("session", F.lit(3))
    rows = lambda d: sorted(map(str, d.collect()))
    for cast in ("timestamp_ntz", "timestamp"):
        x, y = a.withColumn("t", F.col("t").cast(cast)), b.withColumn("t", F.col("t").cast(cast))
        whole = rows(O.asof_join(x, y, ["k"], "t", ["v"]))
        in_order = lambda d: rows(d.withColumn("id", F.when(F.col("t").isNotNull(), F.col("id"))))
        marked = in_order(O.sessions(x, "k", "t", "10 minutes"))  # sessions of rows of null time are dealt in any order
        for split in ("5 minutes", "1 hour", "3 days"):
            assert rows(O.asof_join(x, y, ["k"], "t", ["v"], split=split)) == whole
            assert in_order(O.sessions(x, "k", "t", "10 minutes", split)) == marked
        assert O.sessions(x.limit(0), "k", "t", "10 minutes", "1 hour").columns == O.sessions(x, "k", "t", "10 minutes").columns


def test_bins_of_skipped_hours(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = [dt.datetime(2024, 3, 10, h, m) for h in (1, 2, 3) for m in (0, 20, 40, 50)]
        df = spark.createDataFrame([(1, t) for t in times], "k long, t timestamp_ntz")
        got = O.interval_join(df, df.select("k", F.col("t").alias("u")), ["k"], "t", "u", "20 minutes").count()
        assert got == sum(0 <= (u - t).total_seconds() <= 1200 for t in times for u in times)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_columns(spark):
    df = spark.createDataFrame([(" a  bé\tc\n", '{"k": 3}', 7.5), ("", "no json", 0.0), (None, None, None)], "t string, j string, x double")
    rows = df.select(word_count("t").alias("w"), json_int("j", "$.k").alias("k"), bucket(df.x, 2.0).alias("b"), safe_divide(df.x, df.x).alias("d")).collect()
    assert [tuple(r) for r in rows] == [(3, 3, 3, 1.0), (0, None, 0, None), (None, None, None, None)]


def test_extensions(spark):
    extensions.register(spark)
    df = spark.createDataFrame([("e\u0301", 1.0), (None, 2.0), ("a", None), ("", 100.0)], "s string, x double")
    assert [r[0] for r in df.select(extensions.nfc("s")).collect()] == ["\u00e9", None, "a", ""]
    assert df.agg(extensions.trimmed_mean("x")).first()[0] == 103 / 3
    assert [tuple(r) for r in spark.sql("SELECT * FROM bands(0D, 5D, 2D)").collect()] == [(0, 2), (2, 4), (4, 5)]
    assert spark.sql("SELECT * FROM bands(0D, 5D, 0D)").count() == 0


def test_clashing_names_stay(spark):
    points = spark.createDataFrame([(1, 5.0, "p"), (2, None, "q")], "i long, v double, _bin string")
    ranges = spark.createDataFrame([(0.0, 9.0), (9.0, 9.0), (None, 3.0)], "lo double, hi double")
    assert [tuple(r) for r in O.range_join(points, ranges, "v", "lo", "hi", 4.0).select("i", "_bin").collect()] == [(1, "p")]
    hot = spark.createDataFrame([(1, "s"), (1, "s")], "k long, _salt string")
    assert [r._salt for r in O.salted_join(hot, spark.createDataFrame([(1, 2)], "k long, w long"), ["k"], 3).collect()] == ["s", "s"]
    ev = spark.sql("select 1L k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,x,0) ts, 'n' _new, 'l' _last from values (0), (10), (50), (50) t(x)")
    assert sorted((r.session, r._new) for r in O.sessions(ev, "k", "ts", "30 minutes").collect()) == [(0, "n"), (0, "n"), (1, "n"), (1, "n")]
    assert {r._last for r in O.asof_join(ev, ev.select("k", "ts"), ["k"], "ts", []).collect()} == {"l"}


def test_interval_join_against_all_pairs(spark):
    rnd = random.Random(3)
    left = [(rnd.choice([1, 2, None]), rnd.choice([None, *range(0, 9000, 300)])) for _ in range(60)]
    right = [(rnd.choice([1, 2, None]), rnd.choice([None, *range(0, 9000, 300)])) for _ in range(60)]
    df = lambda rows, c: spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds("s").alias(c))
    got = O.interval_join(df(left, "a"), df(right, "b"), ["k"], "a", "b", "20 minutes").count()
    assert got == sum(k is not None and k == j and None not in (a, b) and a <= b <= a + 1200 for k, a in left for j, b in right)


def test_exact_quantiles(spark):
    rnd = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rnd.integers(0, 9, 300)] + [("b", float(x)) for x in rnd.normal(0, 1, 77)] + [("c", 4.0), ("d", None), (None, 1.0), (None, 2.0), ("b", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double")
    at = {"lo": 0.0, "q": 0.37, "med": 0.5, "hi": 1.0}
    for pieces in (1, 7, 64):
        got = {r.k: tuple(r)[1:] for r in O.exact_quantiles(df, ["k"], "x", at, pieces).collect()}
        for k in ("a", "b", "c", "d", None):
            own = [x for j, x in rows if j == k and x is not None and x == x]
            assert got[k] == ((None,) * 4 if not own else tuple(pytest.approx(np.quantile(own, q)) for q in at.values())), (k, pieces)
    assert O.exact_quantiles(df.filter("k = 'c'"), [], "x", at).first().med == 4.0
    assert O.exact_quantiles(df.limit(0), ["k"], "x", at).count() == 0
