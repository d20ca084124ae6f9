"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

A file holds segments, in ascending order of document. A segment's image is
    magic, sizes | document keys, token counts, byte counts | checkpoints | bits
and each document's bits begin at a whole byte. The checkpoints are the bit
offsets, from the document's first bit, of every BLOCK-th token: a block is
decoded without what comes before it, and all blocks of a segment at once, by
one table of the next LIMIT bits. The code is kept once, as a length for each
id, which is all that a canonical code needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import settled, shuffle_parts
from sparkloom.llm.wordids import packed

MAGIC, LIMIT, BLOCK, SEGMENT_TOKENS = b"SLHB", 16, 1024, 1 << 20
#: Tokens of a range of documents, at most about so many.
PART_TOKENS = 1 << 27


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each id by package-merge: the least total length with none over `limit`; 0 for ids that never occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids need codes of more than {limit} bits")
    if len(ids) < 2:
        out[ids] = 1
        return out
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, weight = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaf, weight])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < len(leaf))
        both = both[sort]
        weight = both[0 : len(both) // 2 * 2 : 2] + both[1 : len(both) // 2 * 2 : 2]
    # of the last level 2n - 2 are taken; a package stands for two of the level before
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.searchsorted(lengths[order], 1) :]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next LIMIT bits: the id, and its code's length."""
    ids = np.lexsort((np.arange(len(lengths)), lengths))
    ids = ids[lengths[ids] > 0]
    span = 1 << (LIMIT - lengths[ids].astype(np.int64))
    size = 1 << LIMIT
    symbol, length = np.zeros(size, np.uint32), np.ones(size, np.uint8)
    symbol[: span.sum()] = np.repeat(ids, span)
    length[: span.sum()] = np.repeat(lengths[ids], span)
    return symbol, length


def encode(size: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each document's bits, those bits, and the bit offset of each token in its document."""
    own = lengths[ids].astype(np.int64)
    if len(own) and not own.all():
        raise ValueError("an id has no code")
    ends = np.concatenate([[0], np.cumsum(own)])
    doc_ends = np.concatenate([[0], np.cumsum(size)])
    n_bytes = (np.diff(ends[doc_ends]) + 7) // 8
    first = np.concatenate([[0], np.cumsum(n_bytes)])
    inside = ends[:-1] - np.repeat(ends[doc_ends[:-1]], size)
    at = np.repeat(8 * first[:-1], size) + inside
    word = codes[ids].astype(np.int64) << (24 - (at & 7) - own)  # 16 bits from any of 8 places
    at >>= 3
    out = np.zeros(int(first[-1]) + 2, np.float64)
    for k, shift in enumerate((16, 8, 0)):
        out[k:] += np.bincount(at, (word >> shift) & 255, minlength=len(out))[: len(out) - k]
    return n_bytes, out[: first[-1]].astype(np.uint8), inside


def image(keys: np.ndarray, known: np.ndarray, size: np.ndarray, n_bytes: np.ndarray, marks: np.ndarray, bits: bytes) -> bytes:
    """A segment."""
    head = MAGIC + np.array([len(keys), len(marks)], "<u4").tobytes()
    return head + keys.astype("<i8").tobytes() + known.astype("u1").tobytes() + size.astype("<u4").tobytes() + n_bytes.astype("<u4").tobytes() + marks.astype("<u8").tobytes() + bits


def open_image(data: bytes, symbol: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, whether each is known (not null), token counts and ids of a segment's documents; all blocks are decoded side by side."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a segment")
    n, m = np.frombuffer(data, "<u4", 2, 4)
    at = 12

    def part(kind: str, many: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, many, at)
        at += out.nbytes
        return out

    keys, known, size, n_bytes, marks = part("<i8", n), part("u1", n), part("<u4", n).astype(np.int64), part("<u4", n).astype(np.int64), part("<u8", m)
    blocks = -(-size // BLOCK)  # an empty document has none
    lane_doc = np.repeat(np.arange(n), blocks)
    nth = np.arange(len(lane_doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.zeros(len(lane_doc), np.int64)
    begin[nth > 0] = marks
    pos = begin + 8 * (np.cumsum(n_bytes) - n_bytes)[lane_doc]
    left = np.minimum(BLOCK, size[lane_doc] - nth * BLOCK)
    out = np.empty(int(size.sum()), np.uint32)
    to = (np.cumsum(size) - size)[lane_doc] + nth * BLOCK
    order = np.argsort(-left, kind="stable")
    pos, to, left = pos[order], to[order], left[order]
    raw = np.concatenate([np.frombuffer(data, np.uint8, offset=at), np.zeros(4, np.uint8)]).astype(np.uint32)
    word = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]  # 24 bits from each byte
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    for step, k in enumerate(active):
        p = pos[:k]
        window = (word[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
        out[to[:k] + step] = symbol[window]
        p += length[window]
    return keys, known.astype(bool), size, out


def count_ids(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in the binary column ids, over all rows; the driver gets one row per id of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            col = b.column(0).cast(pa.large_binary())
            offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
            own = np.bincount(np.frombuffer(col.buffers()[2], "<u4", (offs[-1] - offs[0]) // 4, offs[0])) if offs[-1] > offs[0] else total[:0]
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(settled(work), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(ids: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write documents (key long, n_tokens long, ids binary) under `path`: the code, and the segments in ascending order of key.

    Nulls in key come first; rows of equal key by length, then by crc32 of ids.
    Ranges of keys come from approximate quantiles, and only bits are shuffled.
    Every range is written by one task, of about PART_TOKENS tokens or fewer, or
    of a shuffle partition's share. A segment tells its first token within its
    range; where the ranges begin is added up from the written segments, a number
    for each range. An empty table has a code and no segments.
    """
    spark = ids.sparkSession
    counts = count_ids(ids)
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(lengths[i]), int(counts[i])) for i in np.flatnonzero(lengths)], "id long, bits int, n long").coalesce(1).write.parquet(f"{path}/code")
    parts = max(shuffle_parts(spark), int(-(-counts.sum() // PART_TOKENS)))
    cuts = ids.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("c")).first().c if parts > 1 else []
    bounds = spark.sparkContext.broadcast((np.unique(np.array(cuts or [], np.int64)), lengths, canonical(lengths)))
    schema = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), (key, T.LongType()), ("n_tokens", T.LongType()), ("crc", T.LongType()), ("bits", T.BinaryType()), ("marks", T.BinaryType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, lens, codes = bounds.value
        for whole in batches:
            step = max(1, whole.num_rows * (6 << 20) // max(1, whole.column("ids").nbytes))
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                col = b.column("ids").cast(pa.large_binary())
                offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
                flat = np.frombuffer(col.buffers()[2], "<u4", (offs[-1] - offs[0]) // 4, offs[0])
                size = np.diff(offs) // 4
                n_bytes, bits, inside = encode(size, flat, lens, codes)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                mark = (place % BLOCK == 0) & (place > 0)
                keys = b.column(key)
                part = np.searchsorted(edges, keys.fill_null(0).to_numpy(zero_copy_only=False), "right")
                part[~keys.is_valid().to_numpy(zero_copy_only=False)] = 0
                marks = packed(np.maximum(0, -(-size // BLOCK) - 1), inside[mark].astype("<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), keys.cast(pa.int64()), pa.array(size), b.column("crc"), packed(n_bytes, bits), marks], schema.names)

    coded = ids.select(key, "ids", F.crc32("ids").alias("crc")).mapInArrow(settled(code), schema)
    ranges = len(bounds.value[0]) + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, nth, held = None, 0, 0, []
        names = ["part", "segment", "first_token", "n_docs", "n_tokens", "image"]

        def flush() -> pa.RecordBatch:
            nonlocal start, nth, held
            t = pa.Table.from_batches(held).combine_chunks()
            keys, size = t.column(key), t.column("n_tokens").to_numpy()
            bits, marks = t.column("bits").to_pylist(), t.column("marks").to_pylist()
            data = image(keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(), size, np.array(list(map(len, bits))), np.frombuffer(b"".join(marks), "<u8"), b"".join(bits))
            row = [[part], [nth], [start], [len(size)], [int(size.sum())], [data]]
            start, nth, held = start + int(size.sum()), nth + 1, []
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

        tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column("part")[0].as_py()
            size = batch.column("n_tokens").to_numpy()
            a = 0
            while a < batch.num_rows:
                n = int(np.searchsorted(np.cumsum(size[a:]), SEGMENT_TOKENS - tokens, "left")) + 1
                held.append(batch.slice(a, n))
                tokens += int(size[a : a + n].sum())
                a += n
                if tokens >= SEGMENT_TOKENS:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    placed = coded.repartitionById(ranges, F.col("part")).sortWithinPartitions(F.col(key).asc_nulls_first(), "n_tokens", "crc")
    out = placed.mapInArrow(settled(gather), "part int, segment int, first_token long, n_docs long, n_tokens long, image binary")
    out.write.option("compression", "none").parquet(f"{path}/segments")
    tokens = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row for each range
    begin = np.cumsum([0, *(r.n for r in tokens)])
    spark.createDataFrame([(r.part, int(n)) for r, n in zip(tokens, begin, strict=False)], "part int, begin long").coalesce(1).write.parquet(f"{path}/ranges")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and ids (binary) of each document under `path`, read segment by segment."""
    code = spark.read.parquet(f"{path}/code").collect()  # at most an entry per id of the vocabulary
    lengths = np.zeros(max((r.id for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r.id] = r.bits
    decoder = spark.sparkContext.broadcast(table(lengths))
    schema = T.StructType([T.StructField(n, t) for n, t in ((key, T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.BinaryType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b.column("first_token").to_pylist(), b.column("image"), strict=True):
                keys, known, size, ids = open_image(data.as_buffer(), *decoder.value)
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=~known), pa.array(first + np.cumsum(size) - size), pa.array(size), packed(size, ids)], schema.names)

    begin = F.broadcast(spark.read.parquet(f"{path}/ranges"))  # one row for each range of PART_TOKENS
    placed = spark.read.parquet(f"{path}/segments").join(begin, "part").select((F.col("begin") + F.col("first_token")).alias("first_token"), "image")
    return placed.mapInArrow(settled(work), schema)
