"""Running totals, interpolation, shards, funnels and the joins' and aggregates' edges against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import operators as O
from sparkloom.plans import registered
from sparkloom.sources import manifest, ranked, read_shards, read_table, write_shards
from tests.compare import SMALL, rows_of


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_total(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, rnd.randint(-5, 5)]), "x", 1) for i in range(400)] + [(None, 3, "n", 1)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v long, _range string, total int")
    got = {r.k: r.total for r in O.running_total(df, ["k"], "v", ranges=7).collect()}
    want, total = {}, None
    for k, v, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        total = total if v is None else (total or 0) + v
        want[k] = total
    assert got == want
    assert O.running_total(df.limit(0), ["k"], "v").collect() == []
    assert O.running_total(df, ["k"], "v").columns == ["k", "v", "_range", "total"]


def test_running_total_is_dealt(spark):
    """Only the totals of ranges, one row each, meet in one partition."""
    plan = plan_of(registered()["win_running_total"].run(spark, SMALL))
    single = plan.split("Exchange SinglePartition")
    assert len(single) == 2 and "o_orderkey" not in single[1].split("BroadcastExchange")[0].split("FileScan")[0]


def test_interpolated(spark):
    day = dt.datetime(2024, 1, 1)
    t = lambda h: day + dt.timedelta(hours=h)
    rnd = random.Random(3)
    known = [(k, t(rnd.randint(0, 900)), rnd.random()) for k in (1, 2) for _ in range(30)] + [(3, t(10), 1.0), (1, None, 2.0), (None, t(5), 2.0), (1, t(40), None), (1, t(41), float("nan")), (2, t(55), 0.5), (2, t(55), 0.75)]
    points = [(i, rnd.choice([1, 2]), t(rnd.randint(-5, 905))) for i in range(200)] + [(900, 3, t(10)), (901, 3, t(11)), (902, 4, t(1)), (903, None, t(5)), (904, 1, None), (905, 2, t(55)), (905, 2, t(55))]
    a = spark.createDataFrame(points, "id long, u long, ts timestamp_ntz").withColumn("_piece", F.lit("x"))
    b = spark.createDataFrame(known, "u long, ts timestamp_ntz, v double")
    line = {}
    for k, at, v in known:
        if k is not None and at is not None and v is not None and v == v:
            line.setdefault(k, {})[at] = max(v, line.get(k, {}).get(at, v))
    for split in ("7 days", "2 hours"):
        out = O.interpolated(a, b, "u", "ts", "v", split)
        assert out.columns == ["id", "u", "ts", "_piece", "interpolated"] and out.count() == len(points)
        for r in out.collect():
            own = line.get(r.u, {}) if r.ts is not None else {}
            past, later = [x for x in own if x <= r.ts], [x for x in own if x >= r.ts]
            if not past or not later:
                assert r.interpolated is None
                continue
            x0, x1 = max(past), min(later)
            want = own[x0] if x0 == x1 else own[x0] + (own[x1] - own[x0]) * ((r.ts - x0) / (x1 - x0))
            assert r.interpolated == pytest.approx(want)
    assert O.interpolated(a.limit(0), b, "u", "ts", "v").count() == 0
    assert O.interpolated(a, b.limit(0), "u", "ts", "v").filter("interpolated is not null").count() == 0


def test_shards(spark, tmp_path):
    rows = [(i, f"text {i}", {"a": i}) for i in range(95)] + [(None, "null", None)]
    df = spark.createDataFrame(rows, "k long, t string, m map<string, long>")
    one = write_shards(df.repartition(5), f"{tmp_path}/one", "k", 10)
    two = write_shards(df.repartition(2), f"{tmp_path}/two", "k", 10)
    assert rows_of(one) == rows_of(two) and [r.n_rows for r in one.orderBy("shard").collect()] == [10] * 9 + [6]
    back = read_shards(spark, f"{tmp_path}/one")
    assert sorted(r.place for r in back.collect()) == list(range(1, 97)) and back.filter("shard <> floor((place - 1) / 10)").count() == 0
    assert rows_of(back.drop("m", "shard")) == rows_of(ranked(df, "k", 7).drop("m"))
    assert rows_of(write_shards(df, f"{tmp_path}/other", "k", 10, seed=8)) != rows_of(one)
    with pytest.raises(FileExistsError):
        write_shards(df, f"{tmp_path}/one", "k", 10)
    with pytest.raises(Exception):  # noqa: B017
        write_shards(df.withColumn("bad", F.raise_error(F.lit("no"))), f"{tmp_path}/never", "k", 10)
    assert not (tmp_path / "never").exists()
    write_shards(df.limit(0), f"{tmp_path}/empty", "k", 10)
    assert manifest(spark, f"{tmp_path}/empty").count() == 0


def test_funnel(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 7), (4, "c", 50), (5, "b", 9)], "id long, g string, n long")
    stages = {"small": F.col("n") < 40, "odd": F.col("id") % 2 == 1}
    kept, seen = O.observed_funnel(df, stages, "g", ["a", "b"], "n")
    kept.write.parquet(f"{tmp_path}/kept")
    assert O.funnel_rows(stages, ["a", "b"], seen) == [("all", "a", 2, 5), ("all", "b", 1, 9), ("all", None, 2, 57), ("small", "a", 1, 5), ("small", "b", 1, 9), ("small", None, 1, 7), ("odd", "a", 1, 5), ("odd", "b", 1, 9), ("odd", None, 1, 7)]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [1, 3, 5]
    none, seen = O.observed_funnel(df.limit(0), stages, "g", ["a"], "n")
    none.write.parquet(f"{tmp_path}/none")
    assert O.funnel_rows(stages, ["a"], seen) == []


def test_range_join_of_any_length(spark):
    rnd, inf, nan = random.Random(2), float("inf"), float("nan")
    ranges = [(i, lo := rnd.uniform(-50, 50), lo + 10 ** rnd.uniform(-3, 6)) for i in range(60)]
    ranges += [(100, -inf, 3.0), (101, 2.0, inf), (102, -inf, inf), (103, 5.0, 5.0), (104, nan, 9.0), (105, 1.0, nan), (106, None, 4.0), (107, -1e308, 1e308), (108, 4.0, 1.0), (109, 0.0, 2e7)]
    points = [(i, rnd.uniform(-60, 60)) for i in range(80)] + [(200, nan), (201, None), (202, inf), (203, 1e9), (204, 3.0), (204, 3.0)]
    p, r = spark.createDataFrame(points, "id long, x double").withColumn("_bin", F.lit(1)), spark.createDataFrame(ranges, "r long, lo double, hi double")
    got = sorted((a.id, a.r) for a in O.range_join(p, r, "x", "lo", "hi", 1.0).collect())
    want = sorted((i, k) for i, x in points for k, lo, hi in ranges if None not in (x, lo, hi) and lo <= x < hi)
    assert got == want
    assert O.range_join(p, r.limit(0), "x", "lo", "hi", 1.0).count() == 0


def test_latest_of_any_columns(spark):
    rows = [(1, 5, "a", {"k": 1}, 0), (1, 7, "b", {"k": 2}, 0), (None, None, "c", None, 0), (None, 1, "d", {"k": 3}, 0), (2, None, "e", {"k": 4}, 0)]
    df = spark.createDataFrame(rows, "`_row` long, `a.t` long, v string, m map<string, int>, z int")
    got = sorted(((r[0], r[1], r[2], r[3]) for r in O.latest_per_key(df, ["_row"], ["a.t"]).collect()), key=str)
    assert got == sorted([(1, 7, "b", {"k": 2}), (None, 1, "d", {"k": 3}), (2, None, "e", {"k": 4})], key=str)
    assert O.latest_per_key(df, ["_row"], ["a.t"]).columns == df.columns


def test_salted_join_with_maps(spark):
    df = spark.createDataFrame([(1, {"k": 1}), (1, {"k": 2}), (None, None)], "k long, m map<string, int>")
    assert O.salted_join(df, df.select("k").distinct(), ["k"], 4).count() == 2


def test_quantiles_read_once(spark):
    out = registered()["agg_quantile"].run(spark, SMALL)
    assert "lineitem.parquet" not in plan_of(out)  # the rows were counted into a table, which all else reads


def test_splits_agree(spark):
    """A hot key cut by time gives what one window gives."""
    e = read_table(spark, SMALL, "events").withColumn("user_id", F.lit(1).cast("long"))
    assert rows_of(O.sessions(e, "user_id", "ts", "30 minutes", split="2 days")) == rows_of(O.sessions(e, "user_id", "ts", "30 minutes"))
    left, right = e.filter("event_type = 'purchase'").drop("value"), e.filter("event_type = 'view'")
    assert rows_of(O.asof_join(left, right, ["user_id"], "ts", ["event_id"], split="2 days")) == rows_of(O.asof_join(left, right, ["user_id"], "ts", ["event_id"]))


def test_sketches_are_near(spark):
    rows = registered()["agg_sketch_rollup"].run(spark, SMALL).collect()
    assert len(rows) > 10 and all(r.near for r in rows)
    assert np.isfinite([r.users for r in rows]).all()
