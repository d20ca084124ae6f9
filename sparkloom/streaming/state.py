"""State of our own: running totals, and processors on the RocksDB store with timers and time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value: the store that timers and time to live need.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for f in frames:
        n, total = n + len(f), total + float(f["value"].fillna(0).sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(events: DataFrame) -> DataFrame:
    """Each user's count and total so far, one row for each batch that has events of the user; state is two numbers a user.

    A null value counts as a row and adds 0 to the total; a null user is a user.
    """
    return events.groupBy("user_id").applyInPandasWithState(_advance, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def use_rocksdb(spark: SparkSession) -> None:
    """Make RocksDB the state store of streams that this session starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _micros(spark: SparkSession, length: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {length}"))).first()[0]


class _Unanswered(StatefulProcessor):
    """Holds a key's open events in a list, and one timer: when the first of them is due."""

    def __init__(self, within: int) -> None:
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "first boolean, us long, id long")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest = None
        for f in rows:
            self.held.appendList([(bool(a), int(u), int(i)) for a, u, i in zip(f["first"], f["us"], f["id"], strict=True)])
            at = int(f["us"].min())
            soonest = at if soonest is None else min(soonest, at)
        if soonest is not None:
            self._wake(soonest)
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64")})

    def _wake(self, us: int) -> None:
        """See to it that the timer rings when an event of this time is due."""
        ms = -(-(us + self.within) // 1000)
        if self.due.exists():
            old = self.due.get()[0]
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.held.get(), key=lambda r: r[1])
        answers = np.array([u for first, u, _ in held if not first], np.int64)
        out, keep = [], []
        for first, us, i in held:
            if us + self.within > now:
                keep.append((first, us, i))
            elif first:
                k = int(np.searchsorted(answers, us))
                if k == len(answers) or answers[k] > us + self.within:
                    out.append(i)
        self.due.clear()
        self.held.clear()
        if keep:
            self.held.put(keep)
            self._wake(keep[0][1])
        yield pd.DataFrame({"key": np.full(len(out), key[0], np.int64), "id": np.array(out, np.int64)})

    def close(self) -> None:
        pass


def unanswered(events: DataFrame, first: str, then: str, within: str = "1 hour", late: str = "1 day") -> DataFrame:
    """user_id and event_id of the events of type `first` that no event of type `then` by the same user follows within the time, itself included.

    On a stream an answer is known when the watermark has passed an event by `within`:
    a timer of the user rings, what is due is answered and forgotten with all that can
    answer nothing more, and the next timer is set. So state is what came in the last
    `late` and `within`; rows that come later than the watermark are dropped. The rows
    of a table are all there, and the same events are due: those more than `late` and
    `within` before the last of both types. Rows of null user, time or id play no part;
    ties in time answer each other; repeated rows each give a row.
    """
    spark = events.sparkSession
    both = events.filter(F.col("event_type").isin(first, then)).select(
        F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == first).alias("first")
    )
    both = both.filter("key is not null and id is not null and ts is not null").withColumn("us", F.unix_micros("ts"))
    span = _micros(spark, within)
    if events.isStreaming:
        use_rocksdb(spark)
        grouped = both.withWatermark("ts", late).groupBy("key")
        out = grouped.transformWithStateInPandas(_Unanswered(span), "key long, id long", "append", "eventtime")
    else:
        ahead = Window.partitionBy("key").orderBy("us").rangeBetween(0, span)
        last = both.agg((F.floor(F.max("us") / 1000) * 1000 - _micros(spark, late)).alias("last"))
        answered = both.withColumn("answers", F.count_if(~F.col("first")).over(ahead)).filter("first and answers = 0")
        out = answered.join(F.broadcast(last), F.col("us") + span <= F.col("last"))
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"))


class _FirstSeen(StatefulProcessor):
    """One value a key, which the store forgets when its time to live is over."""

    def __init__(self, live_ms: int) -> None:
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int", self.live_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        for f in rows:
            if not known and len(f):
                self.seen.update((1,))
                known = True
                yield f.iloc[:1]

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, keys: list[str], live_ms: int) -> DataFrame:
    """On a stream without times of its own, a row of each key that was not seen in the last `live_ms` milliseconds of the clock.

    State is one number a key and ends with its time to live, so it needs no watermark.
    A null is a key like others. On a table, one row of each key. A query that is to end
    when all that is there has been read needs spark.sql.streaming.noDataMicroBatches.enabled
    off, since the clock never stops.
    """
    if not rows.isStreaming:
        return rows.dropDuplicates(keys)
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(_FirstSeen(live_ms), rows.schema, "append", "processingtime")
