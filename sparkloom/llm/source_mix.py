"""Mixing sources to target weights by entropy balancing.

Each row has a rate, the copies to take of it, between 0 and MOST. Among all rates
whose words add up to a source's target those are sought that differ least from 1,
by the relative entropy of what is taken and of what is left. They are exponential
tilts, w / (MOST - w) = exp(t * z) / (MOST - 1), where z is a row's size over its
source's mean size, and t, the source's multiplier, is where the convex dual has
slope 0. Newton's iterations find t for all sources at once: each one is a sum over
the table of sizes (how many rows a source has of each size), grouped by source.

Rates are rounded into copies without chance: along the sizes of a source the
fractions are summed, and a group of rows of equal size gets as many further copies
as the rounded sum grows by. So a source's words miss its target by less than half
its largest size (and the step of the multiplier). What is missing or too much then
goes evenly to the sizes that fit in it, with the same rounding, a few times over; each
time at most half of it is left, unless no size fits. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, written
from sparkloom.operators import salted_join

# What a word is.
WORD = r"[^ \t-\r]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rates are whole numbers of 1 / RATE, multipliers of 1 / GRID from -REACH to REACH: so every sum is exact, and reruns agree.
RATE, GRID, REACH = 1 << 20, 1 << 18, 1 << 26
#: Rows of one source and size that are ranked together, about; of more, cells are made by a hash of the key.
CELL = 1024
#: Sources and sizes of more than CELL rows that are broadcast, at most (some 40 bytes each); more are joined with salt.
MOST_HOT = 500_000
SALTS = 16
#: Of so many steps for the multipliers one halves the brackets.
HALVE = 8
#: How often a source's rest after rounding goes to the sizes that fit in it.
MENDS = 5


def words(text: str = "text") -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(key: str, text: str) -> Column:
    """A number below 2^60 that orders a source's rows of one size."""
    of_key = F.conv(F.substring(F.sha2(F.concat(F.lit("mix:"), F.col(key).cast("string")), 256), 1, 15), 16, 10).cast("long")
    return F.coalesce(of_key, F.pmod(F.xxhash64(text), F.lit(1 << 60)))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add weight and target (double) to a table of one row a source (source, n, words).

    Sources by code point, null last, weigh `weights` in turn and share `share` of all
    words; a target above `most` times the source's words stops there, and the excess
    is shared again by weight until none is above. The ranking is the only step that
    sees all sources in one task; it has one row a source. Each round of sharing is an
    aggregate of one row; there are as many as the driver finds sources to stop anew.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    at = F.array(*(F.lit(w) for w in weights))
    sources = written(sources.withColumn("weight", F.element_at(at, (rank % len(weights) + 1).cast("int"))), "mix-weights")
    cap = most * F.col("words")
    total = sources.agg(F.sum("words")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        over = cap <= level * F.col("weight")
        full, live, n = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if not live or n == stopped:
            break
        level, stopped = (share * total - (full or 0)) / live, n
    return sources.withColumn("target", F.when(cap <= level * F.col("weight"), cap.cast("double")).otherwise(level * F.col("weight")))


def _rate(at: Column, most: int) -> Column:
    """A size's rate in 1 / RATE under the multiplier `at` (in 1 / GRID); z is its size over the mean."""
    x = F.least(F.greatest(at / GRID * F.col("z") - F.log(F.lit(float(most - 1))), F.lit(-700.0)), F.lit(700.0))
    return F.floor(most * RATE / (1 + F.exp(-x)) + 0.5)


def _z() -> Column:
    return F.col("size") * F.col("n") / F.nullif(F.col("words"), F.lit(0))


def multipliers(sizes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Add `at` to sources: the least multiplier, in 1 / GRID, whose words reach the target.

    sizes: src, size, m (rows of that size). Newton's steps for all sources at a time,
    kept within brackets that every step narrows; every HALVE-th step halves them. The
    sums that brackets are decided by are of whole numbers, so the answer does not
    depend on the order of rows. The state, one row a source, is a written table.
    """
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("target") / (most * F.greatest(F.col("words"), F.lit(1)))))
    full = F.col("target") >= most * F.col("words")  # a source taken whole, as often as can be, needs no multiplier
    guess = (F.log(share / (1 - share)) + F.log(F.lit(float(most - 1)))) * GRID
    state = written(sources.select("src", "n", "words", "target", F.when(full, REACH - 1).otherwise(-REACH).alias("lo"), F.lit(REACH).alias("hi"), guess.alias("x")), "mix-state")
    sizes = sizes.filter("size > 0")
    step, left = 0, True
    while left:
        step += 1
        near = state.withColumn("k", F.least(F.greatest(F.floor("x"), F.col("lo")), F.col("hi") - 1))
        by_size = sizes.join(near.select("src", "n", "words", "k"), "src").withColumn("z", _z())
        mass = (F.col("m") * F.col("size")).cast("decimal(38,0)")
        own = F.exp(-F.least(F.abs(F.col("k") / GRID * F.col("z") - F.log(F.lit(float(most - 1)))), F.lit(700.0)))
        slope = F.col("m") * F.col("size") * F.col("z") * own / ((1 + own) * (1 + own)) * (most * RATE / GRID)
        summed = by_size.groupBy("src").agg(
            F.sum(mass * _rate(F.col("k"), most)).cast("double").alias("below"), F.sum(mass * _rate(F.col("k") + 1, most)).cast("double").alias("above"), F.sum(slope).alias("slope")
        )
        want = F.col("target") * RATE
        low = F.when(F.coalesce(F.col("above") < want, F.lit(False)) & (F.col("k") + 1 < F.col("hi")), F.col("k") + 1).otherwise(F.when(F.coalesce(F.col("below") < want, F.lit(True)), F.col("k")).otherwise(F.col("lo")))
        high = F.when(F.coalesce(F.col("below") >= want, F.lit(False)) & (F.col("k") > F.col("lo")), F.col("k")).otherwise(F.when(F.coalesce(F.col("above") >= want, F.lit(True)), F.col("k") + 1).otherwise(F.col("hi")))
        # a step on the log-odds of the words taken, which are nearly straight in the multiplier
        cap = (most * RATE * F.col("words")).cast("double")
        odds = lambda c: F.log(c / F.nullif(cap - c, F.lit(0.0)))
        stepped = lambda at, c: at - (odds(c) - odds(want)) * c * (cap - c) / F.nullif(cap * F.col("slope"), F.lit(0.0))
        newton = F.when(F.col("above") < want, stepped(F.col("k") + 1, F.col("above"))).otherwise(stepped(F.col("k"), F.col("below")))
        moved = near.join(summed, "src", "left").withColumns({"a": low, "b": F.greatest(high, low + 1), "y": newton})
        half = (F.col("a") + F.col("b")) / 2
        x = half if step % HALVE == 0 else F.coalesce(F.least(F.greatest(F.when(F.isnan("y"), half).otherwise(F.col("y")), F.col("a").cast("double")), F.col("b") - 1.0), half)
        seen = Observation()
        later = moved.select("src", "n", "words", "target", F.col("a").alias("lo"), F.col("b").alias("hi"), x.alias("x"))
        later = written(later.observe(seen, F.count_if(F.col("hi") - F.col("lo") > 1).alias("open")), "mix-state")
        left = seen.get.get("open", 0) > 0
        discard(state)
        state = later
    return sources.join(state.select("src", F.col("hi").alias("at")), "src")


def _rounded(column: str) -> Column:
    return F.expr(f"({column} + {RATE // 2}) div {RATE}")


def _along(column: str) -> Column:
    """The sum of a column over a source's sizes, from the largest down to a row's own."""
    return F.sum(column).over(Window.partitionBy("src").orderBy(F.col("size").desc(), "cell").rowsBetween(Window.unboundedPreceding, 0))


def _mended(cells: DataFrame, most: int) -> DataFrame:
    """Give what a source's words lack to rows that fit in it, or take it from rows with a further copy, the same share of each size's."""
    own = Window.partitionBy("src")
    rest = F.floor(F.col("target") + 0.5) - F.sum(F.col("size") * (F.col("m") * F.col("base") + F.col("more"))).over(own)
    room = F.when((F.col("size") == 0) | (F.col("size") > F.abs("rest")), 0).when(F.col("rest") < 0, F.col("more")).when(F.col("base") < most, F.col("m") - F.col("more")).otherwise(0)
    cells = cells.withColumn("rest", rest).withColumn("room", room).withColumn("all", F.sum(F.col("room") * F.col("size")).over(own))
    cells = cells.withColumn("part", F.when(F.col("all") > 0, F.col("room") * F.least(F.lit(RATE), F.expr(f"(abs(rest) * {RATE}) div all"))).otherwise(0))
    step = (_rounded("upto") - _rounded("(upto - part)")) * F.signum("rest").cast("long")
    return cells.withColumn("upto", _along("part")).withColumn("more", F.col("more") + step).drop("rest", "room", "all", "part", "upto")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, source, size (words), source_size, target and copies (0 to `most`) of every row of df.

    A null source is a source of its own, after all others; a null or empty text has
    size 0 and no copies. Rows of one source and size are chosen by a hash of the key
    (of the text where the key is null), so ties and repeated rows do not matter: rows
    alike in key, source and size may change places, the rows as a whole do not.
    Other columns of df play no part. Weights are above 0, `most` is 2 or more.

    Texts are read once; after that a row is some 40 bytes. What is grouped by source
    and size is counted where it lies. Sources and sizes of many rows are dealt over
    cells of about CELL rows, so no task gets a hot source, size or group of copies;
    a source's sums run over its cells and sizes, not its rows.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    has = F.when(F.length(F.col(text)) > 0, words(text)).otherwise(F.lit(0)).cast("long")
    slim = written(df.select(F.col(key), F.col(source).cast("string").alias("source"), src.alias("src"), has.alias("size"), _draw(key, text).alias("u")), "mix-sizes")
    sizes = written(slim.groupBy("src", "source", "size").agg(F.count("*").alias("m")), "mix-counts")
    totals = sizes.groupBy("src", "source").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("size")).alias("words"))
    sources = targets(totals, weights, share, most)
    sources = written(multipliers(sizes.select("src", "size", "m"), sources, most).select("src", "n", "words", "target", "at"), "mix-multipliers")
    # cells: rows of a source and size, those of many rows dealt by the hash
    hot = sizes.filter(F.col("m") > CELL).select("src", "size", F.ceil(F.col("m") / CELL).alias("cells"))
    if hot.count() <= MOST_HOT:
        celled = slim.join(F.broadcast(hot), ["src", "size"], "left")
    else:
        celled = salted_join(slim, hot, ["src", "size"], SALTS, "left", F.col("u"))
    celled = celled.withColumn("cell", F.coalesce(F.pmod("u", "cells"), F.lit(0).cast("long"))).drop("cells")
    cells = celled.groupBy("src", "size", "cell").agg(F.count("*").alias("m")).join(sources, "src").withColumn("z", _z())
    rate = F.when(F.col("size") == 0, 0).when(F.col("target") >= most * F.col("words"), most * RATE).otherwise(_rate(F.col("at"), most))
    cells = cells.withColumn("rate", rate.cast("long")).withColumn("part", F.col("m") * (F.col("rate") % RATE))
    cells = cells.withColumn("upto", _along("part")).withColumn("more", _rounded("upto") - _rounded("(upto - part)"))
    cells = cells.select("src", "size", "cell", "m", F.col("words").alias("source_size"), "target", F.expr(f"rate div {RATE}").alias("base"), "more")
    for _ in range(MENDS):
        cells = _mended(cells, most)
    rank = F.row_number().over(Window.partitionBy("src", "size", "cell").orderBy("u", key))
    taken = celled.join(cells.drop("m"), ["src", "size", "cell"]).withColumn("rank", rank)
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("rank") <= F.col("more")).cast("long")).otherwise(0)
    return taken.select(key, "source", "size", "source_size", "target", copies.alias("copies"))


def repeated(df: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of df as often as `mixed` says, by a key that names rows; rows without a copy are left out."""
    often = mixed.filter("copies > 0").select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return df.join(often, F.col(key).eqNullSafe(F.col("_key"))).select(*df.columns)


def digests(df: DataFrame) -> DataFrame:
    """Size, target and words taken of every document."""
    return mix(df).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def oracle_sql() -> str:
    """The same: sharing by rounds, the multipliers by halving brackets."""
    mends = "".join(
        f"""
    r{i} as (select *, floor(target + 0.5)::bigint - sum(size * (m * base + more)) over (partition by source) as rest from q{i}),
    x{i} as (select *, case when size = 0 or size > abs(rest) then 0 when rest < 0 then more when base < {MOST} then m - more else 0 end as room from r{i}),
    y{i} as (select *, sum(room * size) over (partition by source) as whole from x{i}),
    z{i} as (select *, case when whole > 0 then room * least({RATE}, abs(rest) * {RATE} // whole) else 0 end as part from y{i}),
    u{i} as (select *, sum(part) over (partition by source order by size desc, cell rows unbounded preceding) as upto from z{i}),
    q{i + 1} as (select source, size, cell, m, source_size, target, base, more + ((upto + {RATE // 2}) // {RATE} - (upto - part + {RATE // 2}) // {RATE}) * sign(rest) as more from u{i}),"""
        for i in range(MENDS)
    ).rstrip(",")
    rate = f"floor({MOST * RATE} / (1 + exp(-least(greatest({{k}}::double / {GRID} * z, -700.0), 700.0))) + 0.5)::hugeint"
    return f"""
    with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint as size,
        ('0x' || sha256('mix:' || doc_id::varchar)[1:15])::bigint as u from documents),
    s as (select source, count(*) as n, sum(size)::bigint as words from d group by 1),
    w as (select *, [{", ".join(map(str, WEIGHTS))}][((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] as weight from s),
    share as (select 0 as round, 0::double as level
        union all select round + 1, ({SHARE} * (select sum(words) from w) - (select coalesce(sum({MOST} * words), 0) from w where {MOST} * words <= level * weight))
            / (select sum(weight) from w where {MOST} * words > level * weight) from share where round < (select count(*) from w)),
    t as (select w.*, least({MOST} * words, level * weight)::double as target from w, (select level from share where level is not null order by round desc limit 1)),
    h as (select d.source, size, count(*) as m, any_value(size * n::double / words) as z, any_value(target) as target from d join t on d.source is not distinct from t.source where size > 0 group by 1, 2),
    b as (select source, 0 as step, {-REACH}::bigint as lo, {REACH}::bigint as hi from t
        union all select b.source, step + 1, case when g < want then mid else lo end, case when g < want then hi else mid end from (
            select b.source, step, lo, hi, (lo + hi) // 2 as mid, sum(m * size::hugeint * {rate.format(k="((lo + hi) // 2)")})::double as g, any_value(h.target) * {RATE} as want
            from b join h on b.source is not distinct from h.source where hi - lo > 1 group by all) b),
    k as (select source, min(hi) as mult from b group by 1),
    c as (select d.source, d.size, case when count(*) > {CELL} then ceil(count(*) / {CELL})::bigint else 1 end as cells from d group by 1, 2),
    e as (select d.*, u % cells as cell from d join c on d.source is not distinct from c.source and d.size = c.size),
    f as (select e.source, size, cell, count(*) as m, any_value(words) as source_size, any_value(target) as target, any_value(case when size = 0 then 0 when target >= {MOST} * words then {MOST * RATE} else
            floor({MOST * RATE} / (1 + exp(-least(greatest(mult::double / {GRID} * (size * n::double / words), -700.0), 700.0))) + 0.5)::bigint end)::bigint as rate
        from e join t on e.source is not distinct from t.source join k on e.source is not distinct from k.source group by 1, 2, 3),
    o as (select *, sum(m * (rate % {RATE})) over (partition by source order by size desc, cell rows unbounded preceding) as upto, m * (rate % {RATE}) as part from f),
    q0 as (select source, size, cell, m, source_size, target, rate // {RATE} as base, (upto + {RATE // 2}) // {RATE} - (upto - part + {RATE // 2}) // {RATE} as more from o),{mends}
    select doc_id, e.size, source_size, target,
        (e.size * (base + case when row_number() over (partition by e.source, e.size, e.cell order by u, doc_id) <= more then 1 else 0 end))::bigint as taken
    from e join q{MENDS} q on e.source is not distinct from q.source and e.size = q.size and e.cell = q.cell"""
