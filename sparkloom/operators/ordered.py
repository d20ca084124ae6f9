"""Operators that need rows in order: a running total over a whole table, and interpolation between two kinds of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.joins import free_name, time_bin
from sparkloom.sources import settled_table


def running_total(df: DataFrame, order: list[str], value: str, name: str = "total", ranges: int | None = None) -> DataFrame:
    """Add the sum of `value` over all rows up to each one, in ascending order of `order`, nulls first.

    Rows are dealt by ranges of `order` into as many tasks as the session shuffles to
    (or `ranges`) and written once, in the shared folder; a range's total goes on to the
    ranges after it, of which there are no more than tasks; within a range a window adds
    up. So no task sees the whole table. `order` should name rows: rows that tie in it
    lie in one range and are added in any order. A null value adds nothing, and the sum is
    null until there is a value. An empty table stays empty; a column called `name` is replaced.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, before = free_name("_range", df), free_name("_before", df)
    dealt = settled_table(df.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in order)).withColumn(part, F.spark_partition_id()), "running-total")
    totals = dealt.groupBy(part).agg(F.sum(value).alias(before))  # at most `ranges` rows
    ahead = totals.select(part, F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(before))
    own = Window.partitionBy(part).orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    here = F.sum(value).over(own)
    both = F.when(F.col(before).isNull(), here).otherwise(F.col(before) + F.coalesce(here, F.lit(0)))
    out = dealt.join(F.broadcast(ahead), part).withColumn(name, both)
    return out.select(*(c for c in df.columns if c.lower() != name.lower()), name)


def interpolated(points: DataFrame, known: DataFrame, key: str, time: str, value: str, split: str = "7 days", name: str = "interpolated") -> DataFrame:
    """Add to points the value of `known` at their time, on the line between the key's known rows before and after.

    Both sides are cut by key and pieces of time of length `split`; each piece also gets
    the last known row before and the first after it, from one row a piece. The pieces of
    both sides meet as co-groups in Arrow, so a group holds what a key has in `split` and
    two rows more. Null where a point's key or time is null, or it lies before the first
    or after the last known row; of known rows at one time the greatest value counts;
    known rows with a null or NaN are none. Points repeat as they are.
    """
    piece, us = free_name("_piece", points, known), free_name("_us", points)
    micros = lambda df: F.unix_micros(F.col(time).cast("timestamp"))
    a = points.drop(name).withColumn(piece, time_bin(split, time, points, known)).withColumn(us, micros(points))
    b = known.select(F.col(key).alias("k"), time_bin(split, time, points, known).alias("p"), micros(known).alias("u"), F.col(value).cast("double").alias("v"))
    b = b.filter(F.col("k").isNotNull() & F.col("u").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")).groupBy("k", "p", "u").agg(F.max("v").alias("v"))
    places = b.groupBy("k", "p").agg(F.min(F.struct("u", "v")).alias("first"), F.max(F.struct("u", "v")).alias("last"))
    empty = F.lit(None).cast(places.schema["first"].dataType)
    places = places.unionByName(a.filter(F.col(key).isNotNull() & F.col(piece).isNotNull()).select(F.col(key).alias("k"), F.col(piece).alias("p"), empty.alias("first"), empty.alias("last")).distinct())
    places = places.groupBy("k", "p").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    line = Window.partitionBy("k").orderBy("p")
    past = F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    next_ = F.first("first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    edges = places.select("k", "p", past.alias("a"), next_.alias("b")).select("k", "p", F.explode(F.array("a", "b")).alias("e")).filter("e is not null").select("k", "p", "e.u", "e.v")
    schema = T.StructType([*points.drop(name).schema.fields, T.StructField(name, T.DoubleType())])

    def lines(left: pa.Table, right: pa.Table) -> pa.Table:
        x = left[us].to_numpy()
        rows = left.drop_columns([piece, us])
        if not right.num_rows or not left.num_rows:
            return rows.append_column(name, pa.nulls(left.num_rows, pa.float64()))
        u, v = right["u"].to_numpy(), right["v"].to_numpy()
        by = np.argsort(u, kind="stable")
        x = np.where(np.isnan(x.astype(float)), u.min() - 1, x).astype(np.int64)
        base = u[by[0]]
        found = np.interp((x - base).astype(float), (u[by] - base).astype(float), v[by], np.nan, np.nan)
        return rows.append_column(name, pa.array(found, pa.float64(), mask=np.isnan(found)))

    return a.groupBy(key, piece).cogroup(b.select("k", "p", "u", "v").unionByName(edges).groupBy("k", "p")).applyInArrow(lines, schema)
