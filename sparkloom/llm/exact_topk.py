"""Exact top-k by inner product without random access (NRA).

Each block of candidates has a sorted list for every component. A query reads
each list from the end that its own component's sign makes the best, in slices,
all lists to the same depth. An entry that was met is known; one that was not is
at most as good as the last one read. So every candidate has an upper bound, and
the bounds rank those that lead. The scores of LEADERS times k of them are resolved
after each slice: the k-th best of these, and of final scores in earlier blocks of the
task, is the bar. A candidate whose upper bound is under the bar cannot qualify. A query
stops reading when all but FEW of a block's candidates cannot, and the final scores
of those left are resolved from their vectors; else it reads on, to the lists' other
ends if need be. All queries of a block advance together as matrix products.

Queries and candidates are both cut in blocks of bounded size, and every block
of queries meets every block of candidates once, dealt evenly over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import settled, shuffle_parts

#: Vectors in a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 512
#: Shares of a list that have been read when bounds are looked at; at the last all is read.
SLICES = (0.3, 0.36, 0.42, 0.48, 0.55, 0.65, 0.8, 1.0)
#: Share of a block's candidates that may still qualify at which a query stops reading and has their scores resolved.
FEW = 0.03
#: How many of the candidates that lead are resolved after a slice, as a multiple of k.
LEADERS = 4
#: Pairs whose scores are resolved at a time.
_PAIRS = 20_000


def _narrow(x: np.ndarray) -> bytes:
    """The whole numbers of x in the narrowest of 2, 4 and 8 bytes each that holds all of them."""
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return np.ascontiguousarray(x).astype(kind).tobytes()


def _opened(raw: pa.Buffer, rows: int, width: int) -> np.ndarray:
    """The rows that _narrow() has packed."""
    return np.frombuffer(raw, f"<i{raw.size // (rows * width)}").reshape(rows, width)


class Lists:
    """The sorted lists of a block of candidates (rows of x), and what is known of the candidates at each depth of reading."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x.astype(np.float64)
        self.n, self.width = x.shape
        self.value = np.sort(self.x, axis=0)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def entries(self, depth: int) -> int:
        """Entries of each list that are read at a depth."""
        return int(np.ceil(self.n * SLICES[depth]))

    def known(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The greatest and the least that each component can be, read from the upper and from the lower ends: itself where it was met, else the last one read."""
        while len(self.levels) <= depth:
            m = self.entries(len(self.levels))
            self.levels.append((np.maximum(self.x, self.value[self.n - m]), np.minimum(self.x, self.value[m - 1])))
        return self.levels[depth]

    def bounds(self, depth: int, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of every query's score of every candidate."""
        most, least = self.known(depth)
        return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T

    def resolved(self, queries: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Final scores of pairs of a query and a candidate."""
        out = np.empty(len(a))
        for i in range(0, len(a), _PAIRS):
            own = slice(i, i + _PAIRS)
            out[own] = np.einsum("ij,ij->i", queries[a[own]], self.x[c[own]])
        return out


def block_top(lists: Lists, queries: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query and candidate numbers and final scores of all pairs that may be among a query's k best, and how many entries each query read or resolved.

    bar: scores that k candidates of each query have elsewhere (-inf: none). Every
    candidate of the block that ties with or beats the k-th best of all is there.
    """
    n, width, q = lists.n, lists.width, queries.astype(np.float64)
    bar, read, open_ = bar.copy(), np.zeros(len(q), np.int64), np.arange(len(q))
    led = np.zeros(len(q), np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for depth in range(len(SLICES)):
        if not len(open_):
            break
        upper = lists.bounds(depth, q[open_])
        read[open_] = lists.entries(depth) * width
        if n >= k:
            many = min(n, LEADERS * k)
            lead = np.argpartition(upper, n - many, axis=1)[:, n - many :]
            own = lists.resolved(q, np.repeat(open_, many), lead.ravel()).reshape(-1, many)
            bar[open_] = np.maximum(bar[open_], np.partition(own, many - k, axis=1)[:, many - k])
            led[open_] += many
        stay = upper >= bar[open_][:, None]
        done = (stay.sum(1) <= max(FEW * n, k)) | (depth == len(SLICES) - 1)
        at, c = np.nonzero(stay[done])
        pairs.append((open_[done][at], c))
        open_ = open_[~done]
    a, c = (np.concatenate(x) for x in zip(*pairs, strict=True))
    read += (np.bincount(a, minlength=len(q)) + led) * width
    score = lists.resolved(q, a, c)
    good = score >= bar[a]
    return a[good], c[good], score[good], read


class Best:
    """The k best so far of each query of a block: scores and ids, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Take candidates of these queries in."""
        n, k = self.score.shape
        own = np.repeat(np.arange(n), k)
        query, ids, score = np.concatenate([own, query]), np.concatenate([self.ids.ravel(), ids]), np.concatenate([self.score.ravel(), score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.arange(len(query)) - np.searchsorted(query, query) < k
        self.score, self.ids = score[first].reshape(n, k), ids[first].reshape(n, k)


def _packed(vectors: DataFrame, rows: int, name: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of at most `rows` vectors of one length: width, <name>_x (binary, by _narrow()) and <name>_<c> (binary, of longs) for id and the columns `more`."""
    columns = ("id", *more)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        many = 0

        def block(width: int, part: np.ndarray) -> pa.RecordBatch:
            cols = [_narrow(part[:, len(columns) :]), *(np.ascontiguousarray(x).astype("<i8").tobytes() for x in part.T[: len(columns)])]
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], ["width", f"{name}_x", *(f"{name}_{c}" for c in columns)])

        for b in batches:
            col = b.column("x")
            sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns], 1) if b.num_rows else None
            for width in np.unique(sizes):
                own = np.flatnonzero(sizes == width)
                x = flat[(ends - sizes)[own][:, None] + np.arange(width)]
                held.setdefault(int(width), []).append(np.concatenate([keys[own], x], 1))
                many += len(own)
            for width in list(held):
                part = np.concatenate(held.pop(width))
                while len(part) >= rows:
                    yield block(width, part[:rows])
                    part, many = part[rows:], many - rows
                if len(part):
                    held[width] = [part]
            while many >= 4 * rows:  # of very many lengths the commonest goes first
                width = max(held, key=lambda w: len(held[w][0]))
                part = held.pop(width)[0]
                many -= len(part)
                yield block(width, part)
        for width, parts in held.items():
            yield block(width, np.concatenate(parts))

    schema = ", ".join(["width int", f"{name}_x binary", *(f"{name}_{c} binary" for c in columns)])
    return vectors.select(*columns, "x").mapInArrow(settled(work), schema)


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id and x (array of long: floor of scale times each component). Rows of null id or vector, or with a null or non-finite component, go; so do empty vectors."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    df = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & good)
    return df.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = 0.02) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of the highest inner product but itself.

    vectors and queries have id and x (array of long); queries are rows of vectors.
    It is rows that count, not ids: of equal ids each row is a query, and a candidate
    of every query but itself. Ties go to the smaller id, all rows if there are fewer
    than k; rows of another length than the query's are no candidates. Scores are
    exact while they fit 53 bits. Blocks meet in a grid of cells: a block of
    candidates is sent to a row of cells, a block of queries to a column, never
    all vectors to one task, and only a cell's best of a query go on. A cell holds
    its queries and meets its candidates one block at a time. Equal query
    rows are looked up once. `share`, about how many queries there are to a vector,
    shapes the grid.
    """
    parts = shuffle_parts(vectors.sparkSession)
    # a grid of wide by high cells sends least when wide : high is as queries to candidates
    wide = max(1, round((parts * share) ** 0.5))
    high = -(-parts // wide)
    # a row is left out as one of its id and its own score: k + 1 rows hold the k others, whichever of equal rows it is
    own = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v)
    asked = queries.groupBy("id", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn("self", own)
    asked = asked.withColumn("k1", F.xxhash64("id", "x")).withColumn("k2", F.xxhash64(F.lit(1), "x", "id"))
    keys = ("copies", "self", "k1", "k2")
    right = _packed(asked.coalesce(max(1, parts // 12)), QUERIES, "q", keys).withColumn("wide", F.pmod(F.xxhash64("q_id", "q_k1"), F.lit(wide)).cast("int"))
    left = _packed(vectors, CANDIDATES, "c").withColumn("high", F.pmod(F.xxhash64("c_id", "c_x"), F.lit(high)).cast("int"))
    right = right.withColumn("high", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    left = left.withColumn("wide", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    place = ("width", "wide", "high")
    right = right.select(*place, F.lit(False).alias("met"), F.col("q_id").alias("id"), F.col("q_x").alias("x"), *(F.col(f"q_{c}").alias(c) for c in keys))
    left = left.select(*place, F.lit(True).alias("met"), F.col("c_id").alias("id"), F.col("c_x").alias("x"), *(F.lit(None).cast("binary").alias(c) for c in keys))
    # cells have partitions by number, so that none waits for another while tasks are idle; a cell's queries come before its candidates
    cell = F.pmod(F.xxhash64("width") + F.col("wide") * high + F.col("high"), F.lit(parts)).cast("int")
    cells = right.unionByName(left).repartitionById(parts, cell).sortWithinPartitions(*place, "met")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[tuple[list[np.ndarray], np.ndarray, Best]] = []

        def meet(ids: np.ndarray, x: np.ndarray) -> None:
            lists = Lists(x)
            for _, q, own in held:
                a, c, score, _ = block_top(lists, q, k + 1, own.score[:, -1])
                own.add(a, ids[c], score)

        def results() -> Iterator[pa.RecordBatch]:
            for query, _, own in held:
                q, at = np.nonzero(own.score > -np.inf)
                cols = [*(x[q] for x in query), own.ids[q, at], own.score[q, at].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["query_id", *keys, "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                here = tuple(b.column(c)[r].as_py() for c in place)
                if here != now:
                    yield from results()
                    now, held = here, []
                raw = b.column("id")[r].as_buffer()
                ids, x = np.frombuffer(raw, "<i8"), _opened(b.column("x")[r].as_buffer(), raw.size // 8, here[0])
                if b.column("met")[r].as_py():
                    meet(ids, x)
                else:  # copied, so that no batch is kept for its queries
                    held.append(([ids.copy(), *(np.frombuffer(b.column(c)[r].as_py(), "<i8") for c in keys)], x.copy(), Best(len(ids), k + 1)))
                del raw, ids, x
            del b
        yield from results()

    found = cells.mapInArrow(settled(work), ", ".join(f"{c} long" for c in ("query_id", *keys, "vec_id", "score")))
    group = Window.partitionBy("query_id", "k1", "k2")
    ranked = found.withColumn("place", F.row_number().over(group.orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1)
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self")), F.col("place"))).over(group)
    others = ranked.withColumn("itself", F.coalesce(itself, F.lit(k + 1))).filter("place <> itself")
    others = others.withColumn("rank", F.col("place") - (F.col("place") > F.col("itself")).cast("int"))
    again = others.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = 5, every: int = 50) -> str:
    """DuckDB SQL for the rows of top_k() over embeddings."""
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, e.vec_id, CASE WHEN len(q.x) = len(e.x) THEN CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * e.x[i])) AS BIGINT) END AS score
  FROM e q JOIN e ON q.r <> e.r AND len(q.x) = len(e.x) WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= {k}"""
