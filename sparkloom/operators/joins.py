"""Joins that Spark has no single operator for, all as plans that Catalyst can optimise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType


def free_name(name: str, *tables: DataFrame) -> str:
    """`name`, with signs added until no table has a column of it (names are compared without regard to case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def time_bin(length: str, column: str, *tables: DataFrame) -> Column:
    """The number of the piece of `length` (a day-time interval above 0) that a time lies in, never falling as time rises.

    Times without a zone, as the column is in all `tables`, are counted without one, so
    hours that the session's zone skips or repeats do not change their order.
    """
    c, step = F.col(column), F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {length}"))
    if not all(isinstance(t.schema[column].dataType, (TimestampNTZType, DateType)) for t in tables):
        return F.floor(F.unix_micros(c.cast("timestamp")) / step)
    c = c.cast("timestamp_ntz")
    minutes = F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return F.floor((minutes * 60_000_000 + (F.extract(F.lit("second"), c) * 1_000_000).cast("long")) / step)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, columns: list[str], suffix: str = "_asof", split: str | None = None) -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time.

    One union and one window, so one shuffle on the key and no join of rows with
    rows. Left rows without such a right row have nulls. Where right rows tie in
    time, the greatest `columns` win. A null key or time matches nothing.

    With `split` (a day-time interval) a key's rows are dealt over tasks in pieces of
    that length; each piece's last right row is an aggregate, and what a piece finds
    before it comes from those, one row a key and piece. The result is the same.
    """
    value = F.struct(time, *columns)
    side, held, seen, piece, before = (free_name(n, left) for n in ("_side", "_value", "_last", "_piece", "_before"))
    a = left.withColumn(side, F.lit(1)).withColumn(held, F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType))
    b = right.select(*on, F.col(time), F.lit(0).alias(side), value.alias(held)).filter(F.col(time).isNotNull())
    keyed = a.unionByName(b, allowMissingColumns=True)
    keyed = keyed if split is None else keyed.withColumn(piece, time_bin(split, time, left, right))
    parts = on if split is None else [*on, piece]
    ahead = Window.partitionBy(*parts).orderBy(F.col(time).asc_nulls_first(), side, held).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed.withColumn(seen, F.last(held, ignorenulls=True).over(ahead)).filter(F.col(side) == 1)
    if split is not None:
        earlier = Window.partitionBy(*on).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
        carried = keyed.groupBy(*parts).agg(F.max(held).alias(held)).select(*parts, F.last(held, ignorenulls=True).over(earlier).alias(before))
        out = out.join(carried, parts, "left").withColumn(seen, F.coalesce(seen, before))
    known = F.lit(True)
    for k in [*on, time]:
        known = known & F.col(k).isNotNull()
    found = [F.when(known, F.col(f"{seen}.{c}")).alias(f"{c}{suffix}") for c in (time, *columns)]
    return out.select(*left.columns, *found)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, within: str) -> DataFrame:
    """Pairs of equal key whose right time is from the left time to `within` (a day-time interval above 0) later.

    Time is cut in bins of `within`: a right row has its own bin, a left row its own
    and the next, so the join is by key and bin, and a hot key costs the pairs of
    neighbouring bins, not the square of its rows. A null key or time matches nothing;
    ties and repeated rows give each their pairs. Both times are of one type.
    """
    far = F.expr(f"interval {within}")
    own = free_name("_bin", left, right)
    at = time_bin(within, left_time, left)
    a = left.withColumn(own, F.explode(F.array(at, at + 1)))
    b = right.withColumn(own, time_bin(within, right_time, right))
    near = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + far)
    return a.join(b, [*on, own], "inner").filter(near).drop(own)


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= value < high, without an equi-key.

    Ranges are put in levels: those of up to `width` are in bins of `width`, longer ones in
    bins twice as wide for each level, so a range touches two or three bins whatever its
    length. Points are in one bin of each level that occurs, which is looked up first (one
    small number for each). So it is an equi-join on level and bin, not a product, and each
    pair has one bin. Ranges with an infinite end are a level of one bin, which every point
    meets: there should be few. A null or NaN value, low or high matches nothing, nor does
    a range of low >= high; ties and repeated rows give each their pairs.
    """
    own, level = free_name("_bin", points, ranges), free_name("_level", points, ranges)
    lo, hi, endless = F.col(low).cast("double"), F.col(high).cast("double"), 1 << 20
    infinite = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf")) | (hi - lo == float("inf"))
    of = F.when(infinite, endless).otherwise(F.greatest(F.lit(0), F.ceil(F.log2((hi - lo) / width)))).cast("int")
    bin_ = lambda c: F.when(F.col(level) == endless, F.lit(0).cast("double")).otherwise(F.floor(c / (F.pow(F.lit(2.0), F.col(level)) * width)).cast("double"))
    real = ranges.filter((lo < hi) & ~F.isnan(lo) & ~F.isnan(hi)).withColumn(level, of)
    levels = [r[0] for r in real.select(level).distinct().collect()]  # no more than the exponents of a double
    first, last = bin_(lo), bin_(hi)
    spread = real.withColumn(own, F.explode(F.array_distinct(F.array(first, F.least(first + 1, last), last))))
    x = F.col(value).cast("double")
    some = points.filter(F.col(value).isNotNull() & ~F.isnan(x)).withColumn(level, F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    binned = some.withColumn(own, bin_(x))
    return binned.join(spread, [level, own]).filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop(level, own)


def salted_join(hot: DataFrame, other: DataFrame, on: list[str], salts: int, how: str = "inner", spread: Column | None = None) -> DataFrame:
    """An equi-join whose left side's hot keys are dealt over `salts` tasks; the right side is repeated as often.

    For inner, left and left semi or anti joins. `spread` picks a row's salt (by
    default a hash of all its columns but those with maps, so equal runs give equal plans).
    A null key matches nothing; ties and repeated rows give each their pairs.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"the right side cannot be repeated in a {how} join")
    by = F.xxhash64(*("`" + f.name.replace("`", "``") + "`" for f in hot.schema.fields if "map<" not in f.dataType.simpleString())) if spread is None else spread
    own = free_name("_salt", hot, other)
    a = hot.withColumn(own, F.pmod(by, F.lit(salts)).cast("int"))
    b = other.withColumn(own, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, own], how).drop(own)
