"""Best-fit packing after Martello-Toth dominance reduction.

Everything that decides is a count of pieces by length, at most `capacity`
numbers whatever the corpus: the reduction fixes sets of one, two or three
lengths that provably dominate every other set with their largest member, whole
counts at a time; best fit in decreasing order places the rest, also whole
counts at a time. The plan is then a list of bin patterns with repeat counts.
Pieces find their places by their rank among the pieces of equal length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import shuffle_parts


@dataclass(frozen=True)
class Pattern:
    """So many sequences that hold these lengths in this order."""

    bins: int
    lengths: tuple[int, ...]


class _Counts:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, many: int) -> None:
        self.n[size] -= many
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def floor(self, most: int) -> int | None:
        """The largest size of at most `most`."""
        i = bisect_right(self.sizes, most)
        return self.sizes[i - 1] if i else None

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes[:k]:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out


def _dominating(left: _Counts, size: int, room: int) -> tuple[int, ...] | None:
    """Companions for one piece of `size` that dominate all others; one such piece is already taken out of `left`.

    A set dominates another with the same largest member if the other's members
    can be dealt out so that each lot fits under one of its own members.
    """
    best = left.floor(room)
    if best is None:
        return ()
    if best == room:
        return (best,)
    low = left.smallest(3)
    if len(low) < 2 or low[0] + low[1] > room:
        return (best,)
    if len(low) == 3 and sum(low) <= room:
        return None
    # at most two companions fit: the best pair's sum, and the largest lesser member of a pair
    top, lesser, i, j = 0, 0, 0, len(left.sizes) - 1
    while i <= j:
        a, b = left.sizes[i], left.sizes[j]
        if a + b > room or (i == j and left.n[a] < 2):
            j -= 1
            continue
        top, lesser = max(top, a + b), max(lesser, a)
        i += 1
    if top <= best:
        return (best,)
    if (second := left.floor(room - best)) is not None and (second != best or left.n[best] > 1) and second >= lesser:
        return (best, second)
    return None


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Dominating sets for good, and the counts that remain. An optimal packing of the rest gives one of the whole."""
    left, fixed, changed = _Counts(counts), [], True
    while changed:
        changed = False
        for size in sorted(left.n, reverse=True):
            while left.n.get(size):
                left.take(size, 1)
                more = _dominating(left, size, capacity - size)
                insort(left.sizes, size) if size not in left.n else None
                left.n[size] = left.n.get(size, 0) + 1
                if more is None:
                    break
                own = (size, *more)
                need = {s: own.count(s) for s in own}
                # the same companions stay the best, and the smallest stay as large, while they last
                many = min(left.n[s] // k for s, k in need.items())
                for s, k in need.items():
                    left.take(s, k * many)
                fixed.append(Pattern(many, own))
                changed = True
    return fixed, left.n


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in decreasing order of length; equal bins are kept as one group."""
    groups: dict[int, list[list]] = {}  # by room left: [bins, lengths]
    rooms: list[int] = []

    def put(room: int, bins: int, lengths: tuple[int, ...]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([bins, lengths])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                if full := n // per:
                    put(capacity - per * size, full, (size,) * per)
                if n % per:
                    put(capacity - n % per * size, 1, (size,) * (n % per))
                break
            room = rooms[i]
            bins, lengths = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            per = room // size
            full, rest = min(bins, n // per), 0
            if full < bins and n - full * per:
                rest = min(n - full * per, per)
            if full:
                put(room - per * size, full, lengths + (size,) * per)
            if rest:
                put(room - rest * size, 1, lengths + (size,) * rest)
            if over := bins - full - (rest > 0):
                put(room, over, lengths)
            n -= full * per + rest
    return [Pattern(b, x) for own in groups.values() for b, x in own]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold all pieces: counts of pieces by length, each from 1 to capacity."""
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("lengths must be from 1 to capacity")
    fixed, rest = reduce_counts(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where ranks of a length go: runs, sorted by length and first rank.

    A run: length, first (rank), sequence (of the first bin), each (pieces of the length in a bin), offset.
    """
    rows, used, sequence = [], {}, 0
    for p in patterns:
        at = 0
        for size in dict.fromkeys(p.lengths):
            k = p.lengths.count(size)
            rows.append((size, used.get(size, 0), sequence, k, at))
            used[size] = used.get(size, 0) + k * p.bins
            at += k * size
        sequence += p.bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T.copy(), strict=True))


def cut_pieces(ids: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """One row per piece of a document's n_tokens ids: key, piece, start, length, ids."""
    last = F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)).cast("int")
    each = ids.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    length = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - start)
    part = F.when(F.col("n_tokens") <= capacity, F.col("ids")).otherwise(F.substring("ids", (4 * start + 1).cast("int"), F.lit(4 * capacity)))
    return each.select(key, "piece", start.alias("start"), length.alias("length"), part.alias("ids"))


def assign(pieces: DataFrame, capacity: int, key: str = "doc_id", tie: str = "ids_crc32") -> DataFrame:
    """Add sequence_id and offset to pieces of columns key, piece, length (1 to capacity) and tie.

    All pieces are placed. Equal lengths are ranked in salted groups, so that a
    length that a third of the pieces have is dealt over all partitions; the counts
    of groups, not the pieces, give each group its first rank. Pieces equal in
    (key, piece, tie) are alike and may trade places. Nulls in key are a key.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(F.col(key), F.col("piece"), F.lit(17)), F.lit(shuffle_parts(spark))).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # a few per length, whatever the corpus
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_salt").orderBy(key, "piece", tie)
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(first, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first")).select(*pieces.columns, "_rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        by = (r["length"] << 40) + r["first"]
        for b in batches:
            rank, length = b.column("_rank").to_numpy(), b.column("length").to_numpy()
            at = np.searchsorted(by, (length << 40) + rank, "right") - 1
            local = rank - r["first"][at]
            sequence, slot = r["sequence"][at] + local // r["each"][at], local % r["each"][at]
            new = [pa.array(sequence), pa.array(r["offset"][at] + slot * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(put, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (binary) of each packed sequence, from placed pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence has `capacity` ids at most
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("ids"))
