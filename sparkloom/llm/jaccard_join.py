"""N-gram Jaccard self-join by chosen paths.

A text's set is its shingles of WIDTH words. Sets that are equal are one node.
A node has a vector of SKETCH minhash tokens; two nodes agree in each with a
chance that is their similarity. In each run a node takes a few paths, each a
sampled token, and the nodes on a path are a bucket. A bucket that is small, or
whose nodes agree among themselves so often that splitting would not part them,
is compared within itself; any other is split again by sampled tokens. The runs
needed for the target recall follow from the chance that a pair at the threshold
parts in all of them, at the depth that its buckets reach: nodes in buckets that
are split further take further runs. Buckets are compared in cells of bounded size; a pair found in
several buckets counts in the first of them only. Sketches leave out pairs that
are far apart, all others are compared exactly by their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.chunks import slices, string_buffers
from sparkloom.llm.common import discard, discard_made, made, row_key, scratch_path, settled, shuffle_parts, written, written_at
from sparkloom.llm.wordhash import mix, word_hashes

WIDTH = 5
#: The similarity from which on texts are linked, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Minhash tokens of a node, and how many must agree for a pair to be compared exactly
#: (fewer agree at the threshold in about one of 10^6 pairs).
SKETCH, SKETCH_LEAST = 32, 14
#: Tokens sampled at each split (a bucket of less agreement than 1 / SAMPLED shrinks by being split), bucket sizes that need no split, agreement that forbids one, greatest depth.
SAMPLED, SMALL, TIGHT, DEPTH = 2, 128, 0.5, 8
TARGET_RECALL = 0.99999
#: Nodes, and shingles, of a bucket's chunk; a cell has two chunks.
CHUNK_NODES, CHUNK_SHINGLES = 400, 400_000


def _lost(agree: int, splits: int) -> float:
    """The chance that a path parts two nodes that agree in so many of the SKETCH tokens, if its buckets are split so often: by its own token, then by SAMPLED ones at a time."""
    share = agree / SKETCH
    return 1 - share * (1 - (1 - share) ** SAMPLED) ** (splits - 1)


def _agreement() -> dict[int, float]:
    """The chances of a pair at the threshold to agree in so many tokens; pairs that agree in fewer than SKETCH_LEAST are the sketches' loss."""
    p = NUMERATOR / DENOMINATOR
    return {k: math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k) for k in range(SKETCH_LEAST, SKETCH + 1)}


def missed(splits: list[int]) -> float:
    """The chance that all paths part a pair at the threshold, of which each splits its buckets so often. How much it agrees in is the same for all paths."""
    return sum(p * math.prod(_lost(k, s) for s in splits) for k, p in _agreement().items())


def runs_needed(splits: int, target: float = TARGET_RECALL) -> int:
    """Runs of SAMPLED paths until a pair at the threshold is missed with a chance of at most 1 - target, if each path is split `splits` times."""
    return next(r for r in range(1, 1000) if missed([splits] * SAMPLED * r) <= 1 - target)


def _missed_by_node(deep: DataFrame, runs: int) -> DataFrame:
    """node, splits (most of a path) and missed: the bound on missing any of its pairs after so many runs. deep: node, way (a path's number), splits of the paths that split more than once."""
    depth = range(2, DEPTH + 2)
    each = deep.groupBy("node", "way").agg(F.max("splits").alias("splits")).groupBy("node")
    by_node = each.agg(F.max("splits").alias("splits"), F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("splits") == d).alias(f"n{d}") for d in depth))
    log = lambda k, s: math.log(max(_lost(k, s), 1e-300))
    terms = [F.lit(p) * F.exp((F.lit(SAMPLED * runs) - F.col("n")) * log(k, 1) + reduce(lambda x, y: x + y, (F.col(f"n{d}") * log(k, d) for d in depth))) for k, p in _agreement().items()]
    return by_node.select("node", "splits", reduce(lambda x, y: x + y, terms).alias("missed"))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many different shingles each text has, and their hashes, sorted within the text.

    A text of fewer than WIDTH words has one shingle, all its words; one without words none.
    """
    offsets, raw = string_buffers(column)
    n, h = word_hashes(offsets, raw)
    first = np.cumsum(n) - n
    count = np.where(n == 0, 0, np.maximum(1, n - WIDTH + 1))
    of = np.repeat(np.arange(len(n)), count)
    at = np.repeat(first, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    value = np.full(len(of), 7, np.uint64)
    last = (first + n)[of]
    for k in range(WIDTH):
        here = at + k < last
        value[here] = mix(value[here] + np.uint64(k + 1)) ^ h[(at + k)[here]]
    value = mix(value)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return np.bincount(of, minlength=len(n)), value


def _token_keys() -> np.ndarray:
    return mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def nodes_of(count: np.ndarray, value: np.ndarray) -> list[bytes]:
    """16 bytes for each set: two sums over its shingles."""
    out = np.zeros((len(count), 2), np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        starts = (np.cumsum(count) - count)[has]
        out[has, 0] = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5)), starts)
        out[has, 1] = np.add.reduceat(mix(value + np.uint64(0x1234567)), starts)
    return [r.tobytes() for r in out]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, node, n (different shingles) and sig (SKETCH tokens of 4 bytes) of each row of docs; null texts are empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _token_keys()
        for whole in batches:
            for b in slices(whole, "text"):
                count, value = shingles(b.column("text"))
                sig = np.zeros((len(count), SKETCH), "<u4")
                has = np.flatnonzero(count)
                if len(has):
                    starts = (np.cumsum(count) - count)[has]
                    for k in range(SKETCH):
                        sig[has, k] = np.minimum.reduceat((value * keys[k]) >> np.uint64(32), starts)
                cols = [b.column("doc_id").cast(pa.int64()), b.column("row_key"), pa.array(nodes_of(count, value), pa.binary()), pa.array(count.astype(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "node", "n", "sig"])

    return docs.select("doc_id", row_key(docs).alias("row_key"), "text").mapInArrow(settled(work), "doc_id long, row_key long, node binary, n long, sig binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node and shingles (binary, sorted 8-byte hashes) of each row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                count, value = shingles(b.column("text"))
                parts = np.split(value.astype("<u8"), np.cumsum(count)[:-1]) if len(count) else []
                yield pa.RecordBatch.from_arrays([pa.array(nodes_of(count, value), pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())], ["node", "shingles"])

    return docs.select("text").mapInArrow(settled(work), "node binary, shingles binary")


#: Bits of a map that tells which rows are wanted (2 MB, whatever the corpus), and how many bits there must be for each wanted row.
MAP_BITS, MAP_LEAST = 1 << 24, 8


def _in_map(wanted: DataFrame) -> Callable[[F.Column], F.Column] | None:
    """A test of hashes, true for those of wanted (column h, long) and perhaps for some others; None if there are too many for the map.

    The map is broadcast; only the hashes go to Python, rows stay in the JVM.
    """
    wanted = wanted.select("h").distinct()
    if wanted.count() > MAP_BITS // MAP_LEAST:
        return None
    place = lambda h: F.pmod(h, F.lit(MAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(F.col("h")), F.lit(64)).cast("int"))
    words = wanted.groupBy(F.floor(place(F.col("h")) / 64).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 16 bytes each; as rows of Python they would take twenty times as much
    table = np.zeros(MAP_BITS // 64, np.int64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    shared = wanted.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def known(at: pa.Array) -> pa.Array:
        at, bits = at.to_numpy(zero_copy_only=False), shared.value
        return pa.array((bits[at >> 6] >> (at & 63) & 1).astype(bool))

    return lambda h: known(place(h))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of the rows of docs whose doc_id is in wanted (column doc_id, nulls too), and perhaps of some others.

    Up to MAP_BITS / MAP_LEAST wanted ids are told by a map, and no text is
    shuffled; beyond that rows are found by a join.
    """
    # as long on both sides, as sketches() gives ids: the hash of an int differs from that of the same long
    own = F.xxhash64(F.col("doc_id").cast("long"))
    if (known := _in_map(wanted.select(own.alias("h")))) is not None:
        return shingle_sets(docs.filter(known(own)).select("text"))
    wanted = wanted.select(F.col("doc_id").alias("_id")).distinct()
    return shingle_sets(docs.join(wanted, docs.doc_id.eqNullSafe(wanted._id), "left_semi"))


def _token(at: F.Column) -> F.Column:
    return F.substring(F.col("sig"), (4 * at + 1).cast("int"), F.lit(4))


def leaves(nodes: DataFrame) -> DataFrame:
    """leaf, size and node for every place of a node in a bucket that is compared; nodes (node, n, sig) are distinct.

    All nodes take one run more than a single split needs. Those whose buckets were
    split so often that the chance to miss a pair of theirs is still above the target's
    take further runs, as many as the deepest of their buckets needs.
    """
    found, deep, done, pool, need = [], [], 0, nodes, runs_needed(1) + 1
    while True:
        more, split = _runs(pool, nodes, range(done, need))
        found += more
        deep += split
        done = need
        if not deep:
            break
        short = written(_missed_by_node(reduce(DataFrame.unionByName, deep), done).filter(F.col("missed") > 1 - TARGET_RECALL), "join-short")
        most = short.agg(F.max("splits")).first()[0]
        if most is None:
            break
        pool = nodes.join(short.select("node"), "node", "left_semi")
        need = max(done + 2, runs_needed(most))
    return reduce(DataFrame.unionByName, found)


def _runs(pool: DataFrame, nodes: DataFrame, runs: range) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of leaf, size and node of these runs over the nodes in pool, and of node, way (the path's number) and splits of the buckets that were split again.

    The depths lie in folders of one table each, so that all are read by one scan: the
    driver plans, and holds the stages of, two or three scans, however deep buckets were split.
    """
    spark = pool.sparkSession
    paths, marks = scratch_path(spark, "join-paths"), scratch_path(spark, "join-marks")
    ways = [SAMPLED * r + k for r in runs for k in range(SAMPLED)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _token(F.lit(i % SKETCH)).alias("v")) for i in ways)))
    live = pool.select("node", "sig", each.alias("_p")).select(F.xxhash64("_p.i", "_p.v").alias("path"), "node", F.col("_p.i").alias("way"))
    marked = None
    for depth in range(DEPTH + 1):
        size = live.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        live = written_at(live.join(size, "path"), f"{paths}/depth={depth}")
        big = live.filter(F.col("size") > SMALL)
        if depth == DEPTH or big.isEmpty():
            break
        pick = [F.pmod(F.xxhash64("path", F.lit(7 * k + depth)), F.lit(SKETCH)) for k in range(SAMPLED)]
        split = big.join(nodes.select("node", "sig"), "node").select("path", "size", "node", "way", *(_token(p).alias(f"v{k}") for k, p in enumerate(pick)))
        split = written(split, "join-splits")
        # how often two of a bucket's nodes agree, by one token: a split would not part those that agree in most
        parts = split.groupBy("path", "v0").agg(F.max("size").cast("double").alias("size"), F.count(F.lit(1)).cast("double").alias("c"))
        agree = parts.groupBy("path").agg((F.sum(F.col("c") * F.col("c")) / (F.max("size") * F.max("size")) >= TIGHT).alias("tight"))
        marked = written_at(split.join(agree, "path"), f"{marks}/depth={depth}")
        discard(split)
        child = F.explode(F.array(*(F.xxhash64("path", F.lit(k), f"v{k}") for k in range(SAMPLED))))
        live = marked.filter("not tight").select(child.alias("path"), "node", "way")
    whole = spark.read.schema(f"{_ddl(live)}, depth int").parquet(paths)
    found = [whole.filter((F.col("size") <= SMALL) | (F.col("depth") == DEPTH)).select(F.col("path").alias("leaf"), "size", "node")]
    if marked is None:
        return found, []
    whole = spark.read.schema(f"{_ddl(marked)}, depth int").parquet(marks)
    found.append(whole.filter("tight").select(F.col("path").alias("leaf"), "size", "node"))
    return found, [whole.filter("not tight").select("node", "way", (F.col("depth") + 2).alias("splits"))]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each cell, of a stream sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in cols)
        last = tuple(c[-1] for c in cols)
        a = 0
        for e in np.flatnonzero(new):
            if e > a:
                held.append(b.slice(a, e - a))
            if held:
                yield pa.Table.from_batches(held)
            held, a = [], e
        held.append(b.slice(a))
    if held:
        yield pa.Table.from_batches(held)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a cell's two chunks (the same ones for a chunk with itself)."""
    chunk = t.column("chunk").to_numpy()
    a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
    return np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)


def _first_common(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs' first common leaf is this cell's."""
    here = t.column("leaf")[0].as_py()
    lists = t.column("leaves").combine_chunks()
    flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    less = np.flatnonzero(flat < here)
    if not len(less):
        return np.ones(len(i), bool)
    owner = np.searchsorted(offs, less, "right") - 1
    values, code = np.unique(flat[less], return_inverse=True)
    has = np.zeros((len(lists), len(values)), bool)
    has[owner, code] = True
    shared = has[:, has.sum(0) > 1]
    out = np.ones(len(i), bool)
    for k in range(0, len(i), 200_000):
        out[k : k + 200_000] = ~(shared[i[k : k + 200_000]] & shared[j[k : k + 200_000]]).any(1)
    return out


def _near(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell that count here, may be similar by size, and agree in enough tokens."""
    left, right = _sides(t)
    n = t.column("n").to_numpy()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, SKETCH)
    agree = np.zeros((len(left), len(right)), np.uint8)
    for k in range(SKETCH):
        agree += sig[left, k][:, None] == sig[right, k][None]
    ok = agree >= SKETCH_LEAST
    x, y = n[left][:, None], n[right][None]
    ok &= (DENOMINATOR * x >= NUMERATOR * y) & (DENOMINATOR * y >= NUMERATOR * x)
    if t.column("a")[0].as_py() == t.column("b")[0].as_py():
        ok &= left[:, None] < right[None]
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    first = _first_common(t, i, j) if len(i) else np.zeros(0, bool)
    return i[first], j[first]


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left with every right set: frequent shingles by matrix product, rare ones by their pairs."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.concatenate([sets[i] for i in left] + [sets[j] for j in right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(sets[i]) for i in left] + [len(sets[j]) for j in right])
    order = np.argsort(both, kind="stable")
    both, row = both[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
    ends = np.append(starts[1:], len(both))
    of_left = np.concatenate([[0], np.cumsum(row < len(left))])
    fl = of_left[ends] - of_left[starts]
    fr = ends - starts - fl
    some = (fl > 0) & (fr > 0)
    rare = some & (fl * fr <= 64)
    # rows are in order within a shingle, so its left ones come first
    s, a, b = starts[rare], fl[rare], fr[rare]
    pairs = a * b
    base = np.repeat(np.arange(len(s)), pairs)
    k = np.arange(len(base)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    i, j = row[s[base] + k // b[base]], row[s[base] + a[base] + k % b[base]] - len(left)
    out += np.bincount(i * len(right) + j, minlength=out.size).reshape(out.shape)
    often = np.flatnonzero(some & ~rare)
    for at in range(0, len(often), 2048):
        own = often[at : at + 2048]
        size = (ends - starts)[own]
        col = np.repeat(np.arange(len(own)), size)
        pos = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(len(col))
        m = np.zeros((len(left) + len(right), len(own)), np.float32)
        m[row[pos], col] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _cells(rows: DataFrame, parts: F.Column) -> DataFrame:
    """Deal rows of (leaf, node) in cells of two of the leaf's `parts` chunks."""
    spark = rows.sparkSession
    df = rows.withColumn("_k", parts.cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    df = df.withColumn("a", F.least("chunk", "_o")).withColumn("b", F.greatest("chunk", "_o")).drop("_k", "_o")
    return df.repartition(shuffle_parts(spark), "leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "node")


def candidates(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """leaf, node, n, w and leaves of the nodes that have a pair to compare exactly in that leaf."""
    by_node = found.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("leaf", "size"))).alias("_l"))
    known = nodes.join(by_node, "node").withColumn("leaves", F.col("_l.leaf")).select("node", "n", "w", "sig", "leaves", F.explode("_l").alias("_p"))
    rows = known.select(F.col("_p.leaf").alias("leaf"), F.col("_p.size").alias("size"), "node", "n", "w", "sig", "leaves")
    cells = _cells(rows, F.ceil(F.col("size") / CHUNK_NODES)).drop("size")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["leaf", "a", "b"]):
            i, j = _near(t)
            if len(i):
                yield from t.select(["leaf", "node", "n", "w", "leaves"]).take(np.unique(np.concatenate([i, j]))).combine_chunks().to_batches()

    return cells.mapInArrow(settled(work), "leaf long, node binary, n long, w long, leaves array<long>").dropDuplicates(["leaf", "node"])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position linked with each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root, links: per cell and linked node, a node it hangs together with, and how many texts it is linked with there."""
    sized = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_s"))
    rows = rows.join(sized, "leaf").withColumn("_k", F.ceil(F.greatest(F.col("_c") / CHUNK_NODES, F.col("_s") / CHUNK_SHINGLES)))
    slim = rows.select("leaf", "node", "n", "w", "leaves", "_k").withColumn("sig", F.lit(b""))
    cells = _cells(slim.join(sets, "node"), F.col("_k")).drop("sig")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["leaf", "a", "b"]):
            left, right = _sides(t)
            n, w = t.column("n").to_numpy(), t.column("w").to_numpy()
            own = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
            ok = (NUMERATOR + DENOMINATOR) * _common(own, left, right) >= NUMERATOR * (n[left][:, None] + n[right][None])
            if t.column("a")[0].as_py() == t.column("b")[0].as_py():
                ok &= left[:, None] < right[None]
            i, j = np.nonzero(ok)
            i, j = left[i], right[j]
            if not len(i):
                continue
            first = _first_common(t, i, j)
            i, j = i[first], j[first]
            if not len(i):
                continue
            many = np.bincount(i, w[j], len(n)) + np.bincount(j, w[i], len(n))
            has, node = np.flatnonzero(many), t.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(has)), node.take(pa.array(_roots(len(n), i, j)[has])), pa.array(many[has].astype(np.int64))], ["node", "root", "links"])

    return cells.mapInArrow(settled(work), "node binary, root binary, links long")


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (node, root): label is the least node that it hangs together with.

    Alternates stars of neighbours (each node's larger neighbours, then its
    smaller ones, move to its least one) until nothing moves; each round is a
    table in the shared folder, and only its checksum comes to the driver.
    """
    now = written(edges.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).filter("u <> v").distinct(), "join-edges")
    # edges are distinct, so these three tell one set of them from another
    same = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u")))
    mark = now.agg(*same).first()
    while True:
        # each table is read by few scans: a plan that repeats its own parts holds their stages in the driver at once
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("_e")).select("_e.u", "_e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "join-large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        new = written(large.join(small, "u").select(ends.alias("_e")).select("_e.u", "_e.v").filter("u <> v").distinct(), "join-edges")
        discard(large)
        mark, old = new.agg(*same).first(), mark
        discard(now)
        now = new
        if mark == old:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables: every row's sketch, the nodes, the nodes' labels where linked, and links by node and cell."""
    every = written(sketches(docs), "join-sketches")
    nodes = every.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("w"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes, "join-nodes")
    before = made()
    rows = written(candidates(nodes, leaves(nodes)), "join-candidates")
    discard_made(docs.sparkSession, before, "join-paths", "join-marks", "join-short")
    needed = nodes.join(rows.select("node").distinct(), "node", "left_semi")
    # of a node's rows the one of its least doc_id is wanted; others may come along
    sets = sets_of(docs.select("doc_id", "text"), needed).groupBy("node").agg(F.first("shingles").alias("shingles"))
    linked = written(links(rows, sets), "join-links")
    discard(rows)
    return every, nodes, components(linked), linked


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of each row of docs (columns doc_id, text).

    Rows are linked if their shingle sets have a Jaccard similarity of at least
    NUMERATOR / DENOMINATOR; n_links counts a row's links, class_id is the least
    doc_id of the rows that it hangs together with by links, its own if it has
    none. Rows of equal shingles are linked, whether or not they are copies. Rows
    without words, or of null text, are linked with nothing. A null doc_id stays
    null, and is the least only where all of a class are null. Other columns are
    ignored, repeated rows each give a row, an empty table gives none. Shingles
    are compared by 64-bit hashes. No pair leaves its cell: cells give counts and
    spanning links, and equal rows are one node with a weight.
    """
    every, nodes, label, linked = _linked(docs)
    least = label.join(nodes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    degree = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(label.join(least, "label").select("node", "class_id"), "node", "left").join(degree, "node", "left")
    known = known.filter("w > 1 or links is not null").select("node", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    # written, so that both sides of the join are plain shuffles and a node that many rows have can be split
    out = every.select("doc_id", "node").join(written(known, "join-classes"), "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns whatever their names, that stay when each class keeps one: its least doc_id (nulls last), then row_key.

    Rows without words all stay. Of rows alike in id, text, language and source one stays.
    Rows of classes of their own pass where they lie, if a map tells them (see
    sets_of()); only the others meet the keys of those that stay.
    """
    every, nodes, label, _ = _linked(docs)
    rows = every.filter("n > 0").groupBy("node", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("c"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "c")).alias("b")
    by_node = rows.groupBy("node").agg(best, F.sum("c").alias("many")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    stay = by_node.groupBy("label").agg(F.min("b").alias("b")).select(F.col("b.doc_id").alias("_i"), F.col("b.row_key").alias("_k"), (F.col("b.c") > 1).alias("_again"))
    stay = written(stay.unionByName(every.filter("n = 0").select(F.col("doc_id").alias("_i"), F.col("row_key").alias("_k"), F.lit(False).alias("_again")).distinct()), "join-stay")
    keyed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_own"), row_key(docs).alias("_row"))
    shared = written(nodes.join(label, "node", "left").filter("w > 1 or label is not null").select("node"), "join-shared")
    known = _in_map(every.join(shared, "node", "left_semi").select(F.xxhash64("doc_id", "row_key").alias("h")))
    if known is not None:
        keyed = keyed.withColumn("_met", known(F.xxhash64("_own", "_row")))
        alone, keyed = keyed.filter("not _met").select("_doc.*"), keyed.filter("_met")
    rows = written(keyed.join(stay, keyed._own.eqNullSafe(stay._i) & (keyed._row == stay._k)).drop("_i", "_k"), "join-kept")
    once = rows.filter("not _again").unionByName(rows.filter("_again").dropDuplicates(["_own", "_row"])).select("_doc.*")
    return once if known is None else alone.unionByName(once)


def oracle_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of join(): every pair that shares a shingle, then classes by recursion."""
    words = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
    grams = f"CASE WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[k:k + {WIDTH - 1}], ' ') FOR k IN range(1, len(w) - {WIDTH - 2})] END"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM {documents}),
s AS MATERIALIZED (SELECT DISTINCT r, unnest({grams}) AS g FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
  HAVING {NUMERATOR + DENOMINATOR} * count(*) >= {NUMERATOR} * ((SELECT n FROM n WHERE n.r = a.r) + (SELECT n FROM n WHERE n.r = b.r))),
c AS (SELECT r, r AS o FROM d UNION SELECT c.r, p.b FROM c JOIN p ON c.o = p.a)
SELECT d.doc_id, min(e.doc_id) AS class_id, (SELECT count(*) FROM p WHERE p.a = d.r) AS n_links
FROM d JOIN c ON c.r = d.r JOIN d e ON e.r = c.o GROUP BY d.r, d.doc_id"""
