"""Windowed counts, sessions, duplicates and joins behind watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_time(events: DataFrame, late: str = "1 hour", column: str = "ts") -> DataFrame:
    """The time column as an instant (watermarks need one), with rows later than `late` to be dropped by what follows.

    A null time stays null and moves no watermark.
    """
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def _counts(grouped) -> DataFrame:
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    keys = [c for c in out.columns if c not in ("span", "n", "total")]
    ends = (F.col(f"span.{e}").cast("timestamp_ntz").alias(f"span_{e}") for e in ("start", "end"))
    return out.select(*ends, *keys, "n", "total")


def tumbling(events: DataFrame, length: str = "1 day") -> DataFrame:
    """Counts and totals by type in windows side by side.

    Rows of null time are in no window; a null type is a type; a null value counts as a row
    and adds nothing, and a total of nulls only is null. Repeated rows count each.
    """
    return _counts(events.groupBy(F.window("ts", length).alias("span"), "event_type"))


def sliding(events: DataFrame, length: str = "1 day", every: str = "12 hours") -> DataFrame:
    """The same in windows that overlap: a row counts in each that holds its time."""
    return _counts(events.groupBy(F.window("ts", length, every).alias("span"), "event_type"))


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's sessions: events less than `gap` apart; nulls as in tumbling(), a null user is a user."""
    return _counts(events.groupBy(F.session_window("ts", gap).alias("span"), "user_id"))


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key: within the watermark on a stream, of all rows on a table. Null keys are alike; which of rows that tie stays is open."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def follow_ups(first: DataFrame, then: DataFrame, within: str = "1 hour") -> DataFrame:
    """Ids of a user's event and of one in the time after it; both sides bounded by the watermarks and the range.

    A null user or time matches nothing; events at one time match; repeated rows give each their pairs.
    """
    a = first.select(F.col("user_id").alias("_u"), F.col("event_id").alias("first_id"), F.col("ts").alias("_t"))
    b = then.select("user_id", F.col("event_id").alias("then_id"), "ts")
    near = (F.col("_u") == F.col("user_id")) & (F.col("ts") >= F.col("_t")) & (F.col("ts") <= F.col("_t") + F.expr(f"interval {within}"))
    return a.join(b, near).select("first_id", "then_id")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return the rows, from a table in memory; for tests and reports."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
