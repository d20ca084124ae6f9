"""Top rows, latest rows, pivots and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.joins import free_name, time_bin
from sparkloom.sources import settled_table


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes groups before the shuffle (WindowGroupLimit).

    A null in `by` is a group like others; rows that tie in `order` come in any order; a column called `name` is replaced.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def _quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def latest_per_key(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in `order`, then in the other columns: an aggregate, so a hot key is reduced where it lies.

    A null is the least value, and a null key a key; maps cannot be compared, so of rows alike
    in all other columns any one's map is taken. Column names may hold dots.
    """
    rest = [c for c in df.columns if c not in by and c not in order]
    ranked = [f.name for f in df.schema.fields if f.name in rest and not _holds_map(f.dataType)]
    row = free_name("_row", df)
    values = [c for c in df.columns if c not in by]
    whole = F.struct(*(_quoted(c).alias(f"c{i}") for i, c in enumerate(values)))
    place = F.struct(*(_quoted(c).alias(f"o{i}") for i, c in enumerate((*order, *ranked))))
    best = df.groupBy(*map(_quoted, by)).agg(F.max_by(whole, place).alias(row))
    at = {c: F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(values)}
    return best.select(*(at.get(c, _quoted(c)) for c in df.columns))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def pivot_counts(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """A count column for each of the given values, 0 where there is no row; nulls in `column` are counted nowhere, a null in `by` is a group."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row for each row and column, of nulls too; columns share one type."""
    return df.unpivot(keys, columns, name, value)


def exact_quantiles(df: DataFrame, by: list[str], column: str, at: dict[str, float], pieces: int = 64) -> DataFrame:
    """by and a column for each of `at` (name: share from 0 to 1): quantiles with linear interpolation; null where a group has no value.

    Values are counted first, once, into a table of the shared folder, so df is read once
    and repeats do not travel; each group's range is cut in
    `pieces` between its extremes, counts of pieces tell where each quantile lies, and
    only the values of those pieces are ranked. So no task holds a group whole.
    Nulls and NaN are left out; groups of nulls only stay. A column in `by` that bears
    a name of `at` is an error of the caller's; other columns are ignored.
    """
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(by)] or [F.lit(0).alias("k0")]  # without `by` all rows are one group
    names = [f"k{i}" for i in range(len(keys))]
    x = F.col(column).cast("double")
    n = df.select(*keys, F.nanvl(x, F.lit(None)).alias("x")).groupBy(*names, "x").agg(F.count("x").alias("n"))
    n = settled_table(n, "value-counts")
    ends = n.groupBy(*names).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("all"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    joined = lambda a, b, how="inner": a.alias("a").join(b.alias("b"), same("a", "b"), how)
    width = (F.col("high") - F.col("low")) / pieces
    piece = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(pieces - 1))).otherwise(F.lit(0)).cast("int")
    own = [F.col(f"a.{k}") for k in names]
    placed = joined(n.filter("x is not null"), ends).select(*own, "x", "n", "low", "high", "all", piece.alias("piece"))
    counted = placed.groupBy(*names, "piece").agg(F.sum("n").alias("m"))
    before = F.sum("m").over(Window.partitionBy(*names).orderBy("piece")) - F.col("m")  # at most `pieces` rows a group
    counted = counted.withColumn("before", before)
    # the ranks (from 0) on both sides of each quantile
    ranks = F.array(*(F.struct(F.lit(i).alias("q"), (F.lit(p) * (F.col("all") - 1)).alias("want")) for i, p in enumerate(at.values())))
    wanted = ends.filter("all > 0").select(*names, F.explode(ranks).alias("w")).select(*names, "w.q", "w.want")
    hit = joined(counted, wanted).filter((F.floor("want") < F.col("before") + F.col("m")) & (F.ceil("want") >= F.col("before")))
    hit = hit.select(*own, "piece", "before", "q", "want")
    met = placed.alias("a").join(hit.alias("b"), [*same("a", "b"), F.col("a.piece") == F.col("b.piece")])
    met = met.select(*own, "a.piece", "x", "n", "before", "q", "want")
    upto = F.sum("n").over(Window.partitionBy(*names, "q", "piece").orderBy("x")) + F.col("before")
    met = met.withColumn("upto", upto).withColumn("since", F.col("upto") - F.col("n"))
    value = lambda r: F.max(F.when((F.col("since") <= r) & (r < F.col("upto")), F.col("x")))
    low, high = F.floor("want"), F.ceil("want")
    found = met.groupBy(*names, "q").agg(value(low).alias("below"), value(high).alias("above"), F.max("want").alias("want"))
    found = found.withColumn("v", F.col("below") + (F.col("above") - F.col("below")) * (F.col("want") - F.floor("want")))
    wide = found.groupBy(*names).agg(*(F.max(F.when(F.col("q") == i, F.col("v"))).alias(f"v{i}") for i in range(len(at))))
    every = joined(ends, wide, "left")
    return every.select(*(c.alias(k) for c, k in zip(own, by, strict=False)), *(F.col(f"v{i}").alias(name) for i, name in enumerate(at)))


def sessions(df: DataFrame, key: str, time: str, gap: str, split: str | None = None) -> DataFrame:
    """Add session (from 0 for each key): a new one begins where the time since the row before is over `gap`.

    Rows of equal time are in one session; a null key is a key; rows of null time come
    first, each a session. A column of df named session is replaced.

    With `split` (a day-time interval) a key's rows are dealt over tasks in pieces of
    that length. Ahead of each piece goes one row with the last time before it and the
    number of sessions begun by then, from aggregates by key and piece; so rows meet no
    join. The result is the same.
    """
    new, mark, piece = (free_name(n, df) for n in ("_new", "_mark", "_piece"))
    begins = lambda own: F.lag(time).over(own).isNull() | (F.col(time) > F.lag(time).over(own) + F.expr(f"interval {gap}"))
    if split is None:
        own = Window.partitionBy(key).orderBy(time)
        counted = F.sum(new).over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1
        return df.withColumn(new, begins(own).cast("int")).withColumn("session", counted).drop(new)
    rows = df.withColumn(piece, time_bin(split, time, df)).withColumn(mark, F.lit(1))
    own = Window.partitionBy(key, piece).orderBy(mark, time)  # a row of mark 0 tells of the pieces before
    pieces = Window.partitionBy(key).orderBy(piece)
    last = F.lag(time).over(pieces).alias(time)
    slim = rows.select(key, time, piece, mark)
    ends = slim.groupBy(key, piece).agg(F.max(time).alias(time)).select(key, last, piece, F.lit(0).alias(mark))
    begun = slim.unionByName(ends).withColumn(new, begins(own).cast("long")).filter(F.col(mark) == 1)
    begun = begun.groupBy(key, piece).agg(F.max(time).alias(time), F.sum(new).alias(new))
    so_far = F.sum(new).over(pieces.rowsBetween(Window.unboundedPreceding, -1)).alias(new)
    ahead = begun.select(key, last, piece, F.lit(0).alias(mark), so_far).filter(F.col(new).isNotNull())
    placed = rows.unionByName(ahead, allowMissingColumns=True).withColumn(new, F.coalesce(new, begins(own).cast("long")))
    counted = F.sum(new).over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return placed.withColumn("session", counted).filter(F.col(mark) == 1).drop(new, mark, piece)
