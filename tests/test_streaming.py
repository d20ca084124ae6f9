"""Streams over shuffled files give the batch answer, but for what the watermark drops."""

import datetime as dt

from pyspark.sql import functions as F

from sparkloom import streaming as S
from sparkloom.sources import read_table, stream
from tests.compare import SMALL, rows_of


def _files(spark, folder):
    e = read_table(spark, SMALL, "events")
    e.orderBy(F.md5(F.col("event_id").cast("string"))).repartition(3).write.parquet(f"{folder}/events")
    return stream(spark, f"{folder}/events", e.schema, files_each=10)


def test_tumbling_equals_batch_but_open_windows(spark, tmp_path):
    live = S.drain(S.tumbling(S.event_time(_files(spark, tmp_path), "60 days")), "tumbling", f"{tmp_path}/c", "complete")
    assert rows_of(live) == rows_of(S.tumbling(S.event_time(read_table(spark, SMALL, "events"))))


def test_follow_ups_and_duplicates(spark, tmp_path):
    e = S.event_time(_files(spark, tmp_path), "60 days")
    live = S.drain(S.follow_ups(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'")), "follow", f"{tmp_path}/c")
    b = S.event_time(read_table(spark, SMALL, "events"))
    assert rows_of(live) == rows_of(S.follow_ups(b.filter("event_type = 'view'"), b.filter("event_type = 'purchase'")))
    once = S.drain(S.deduplicated(e, ["user_id", "event_type"]).select("user_id", "event_type"), "once", f"{tmp_path}/d")
    assert rows_of(once) == rows_of(b.select("user_id", "event_type").distinct())


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    day = lambda d: dt.datetime(2024, 1, d)
    for k, rows in enumerate(([(1, day(10), 1, "view", 1.0)], [(2, day(20), 1, "view", 1.0)], [(3, day(2), 1, "view", 1.0), (4, day(25), 1, "view", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/late/{k}")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/late")
    out = S.drain(S.tumbling(S.event_time(read, "1 day")), "late", f"{tmp_path}/c").select("span_start").collect()
    assert day(2) not in [r.span_start for r in out] and day(10) in [r.span_start for r in out]


def test_running_totals(spark, tmp_path):
    live = S.drain(S.running_totals(_files(spark, tmp_path)), "totals", f"{tmp_path}/c", "update")
    last = live.groupBy("user_id").agg(F.max("n").alias("n"))
    assert rows_of(last) == rows_of(read_table(spark, SMALL, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))


def _in_order(spark, folder, pieces=6, late=()):
    """The small events table as files in order of time, each shuffled within; and rows that come after all of them."""
    e = read_table(spark, SMALL, "events")
    rows = e.orderBy("ts").collect()
    size = -(-len(rows) // pieces)
    for k in range(pieces):
        own = sorted(rows[k * size : (k + 1) * size], key=lambda r: hash((r.event_id, 7)))
        spark.createDataFrame(own, e.schema).coalesce(1).write.parquet(f"{folder}/ordered/{k}")
    if late:
        spark.createDataFrame(list(late), e.schema).coalesce(1).write.parquet(f"{folder}/ordered/late")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/ordered")


LATE = [(9_000_001, dt.datetime(2024, 1, 1, 0, 30), 3, "purchase", 1.0, "{}"), (9_000_002, dt.datetime(2024, 1, 1, 0, 30), 3, "view", 1.0, "{}")]


def test_timers_ring_and_state_expires(spark, tmp_path):
    """Files out of order within, and rows behind the watermark, give the batch twin's answer over the rows in time."""
    e = read_table(spark, SMALL, "events")
    live = S.drain(S.unanswered(_in_order(spark, tmp_path, late=LATE), "view", "purchase", late="5 days"), "unanswered", f"{tmp_path}/c")
    want = S.unanswered(e, "view", "purchase", late="5 days")
    assert rows_of(live) == rows_of(want) and live.count() > 50
    state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "held").load()
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    assert 0 < state.count() < e.filter("event_type in ('view', 'purchase')").count() * 7 / (last - first).days


def test_unanswered_edges(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, t(0), 1, "view"), (2, t(60), 1, "purchase"), (3, t(61), 1, "view"), (3, t(61), 1, "view"), (4, t(200), 1, "view"), (5, t(200), 1, "purchase"), (6, None, 1, "view"), (7, t(5), None, "view"), (None, t(9), 1, "view"), (8, t(9), 2, None), (9, t(9), 2, "view"), (10, t(9000), 2, "view")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    assert sorted(tuple(r) for r in S.unanswered(df, "view", "purchase").collect()) == [(1, 3), (1, 3), (2, 9)]
    assert S.unanswered(df.limit(0), "view", "purchase").count() == 0


def test_time_to_live(spark, tmp_path):
    """Keys that come again are new only when the store has forgotten them."""
    schema = "k string, v long"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # the clock alone would start batches for ever
    for name, live_ms, again in (("short", 1, 3), ("long", 3_600_000, 1)):
        for run in range(2):
            rows = [("a", run), ("a", run), (None, run), *([("b", run)] if run else [])]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{run}")
            read = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
            query = S.first_seen(read, ["k"], live_ms).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start()
            query.awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/{name}-out")
        assert out.filter("v = 0").count() == 2 and out.filter("v = 1").count() == again, name
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert S.first_seen(spark.createDataFrame(rows, schema), ["k"], 1).count() == 3


def test_sliding_and_sessions_as_streams(spark, tmp_path):
    """Windows that the watermark has closed equal the batch answer; rows behind it change nothing."""
    e = S.event_time(read_table(spark, SMALL, "events"))
    end = "timestamp_ntz '2024-01-24 00:00:00'"
    for name, build in (("sliding", S.sliding), ("sessions", S.session_counts)):
        live = S.drain(build(S.event_time(_in_order(spark, f"{tmp_path}/{name}", late=LATE), "2 days")), name, f"{tmp_path}/{name}/c")
        assert rows_of(live.filter(f"span_end < {end}")) == rows_of(build(e).filter(f"span_end < {end}")), name
