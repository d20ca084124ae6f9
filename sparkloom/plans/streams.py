"""Batch twins of the streaming operators, and one that runs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import streaming as S
from sparkloom.plans.registry import Query
from sparkloom.sources import read_table, shared_path, stream


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return S.event_time(read_table(spark, folder, "events"))


def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts by type."""
    return S.tumbling(_events(spark, folder))


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a day, every half day."""
    return S.sliding(_events(spark, folder))


def stream_session(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by user."""
    return S.session_counts(_events(spark, folder))


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of user and type that occur."""
    return S.deduplicated(_events(spark, folder), ["user_id", "event_type"]).select("user_id", "event_type")


def stream_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases within an hour of a view."""
    e = _events(spark, folder)
    return S.follow_ups(e.filter(F.col("event_type") == "view"), e.filter(F.col("event_type") == "purchase"))


def stream_stateful(spark: SparkSession, folder: str) -> DataFrame:
    """Views that no purchase of the user follows within an hour: the table as a stream, with state and timers, into files of the shared folder."""
    live = stream(spark, f"{folder.rstrip('/')}/events.parque[t]", read_table(spark, folder, "events").schema, files_each=100)
    out, path = S.unanswered(live, "view", "purchase"), shared_path(spark, "stream-stateful")
    done = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


_SUMS = "event_type, count(*) AS n, round(sum(value), 2) AS total"
QUERIES: dict[str, Query] = {
    "stream_tumbling": Query(stream_tumbling, f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS span_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS span_end, {_SUMS} FROM events GROUP BY 1, 2, 3"),
    "stream_sliding": Query(
        stream_sliding,
        f"SELECT s AS span_start, s + INTERVAL 1 DAY AS span_end, {_SUMS} FROM (SELECT *, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 12 HOUR * k AS s FROM events, (VALUES (0), (1)) v(k)) GROUP BY 1, 2, 3",
    ),
    "stream_session": Query(
        stream_session,
        "SELECT min(ts) AS span_start, max(ts) + INTERVAL 30 MINUTE AS span_end, user_id, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s "
        "FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s",
    ),
    "stream_dedup": Query(stream_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_stateful": Query(
        stream_stateful,
        "WITH e AS (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type IN ('view', 'purchase')) SELECT user_id, event_id FROM e v WHERE event_type = 'view' AND us + 3600000000 <= ((SELECT max(us) FROM e) // 1000 - 86400000) * 1000 "
        "AND NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.us >= v.us AND p.us <= v.us + 3600000000)",
    ),
    "stream_interval_join": Query(
        stream_interval_join,
        "SELECT v.event_id AS first_id, p.event_id AS then_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR",
    ),
}
