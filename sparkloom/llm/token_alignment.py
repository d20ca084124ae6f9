"""Alignment of two tokenizers' tokens by their bytes, and how often ids are linked in the whole corpus.

The ends of either tokenizer's tokens are ones in a packed bit vector over the
bytes of a batch of chunks. The AND of both holds the shared cuts, whose ranks are
the token ranges of the groups. The OR holds one place for each pair of tokens
that overlap: the bytes up to it from the place before lie in one token of either
side, and the ranks of the place say in which. Chunks are cut where both
tokenizers end a token whatever surrounds it, and each distinct one is aligned
once by a worker.

Counts of id pairs come from blocks: a block is the texts of some megabytes, as
numbers of its distinct chunks, and a list of its distinct pairs. Only those lists
are added up over the corpus and looked up again; texts are read once.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.bitvector import Bits
from sparkloom.llm.chunks import MARKS_KEPT, ChunkCache, cut, distinct, slices, string_buffers
from sparkloom.llm.common import settled, written
from sparkloom.llm.prefix_tokens import PATTERN, byte_alphabet
from sparkloom.llm.sentencepiece_tokenizers import BYTE, MARK, NORMAL, USER, cutting_marks, parse, separable

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Numbers at the head of a chunk's row: tokens of A and of B, groups, links; a chunk whose tokens do not spell it has no row but BAD.
HEAD, BAD = 4, np.uint32(0xFFFFFFFF)


def _begins(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


class Strings:
    """Byte strings by number, spelt out for whole arrays of numbers."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start, self.flat = _begins(self.size), np.frombuffer(b"".join(strings), np.uint8)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes, and the bytes one after another."""
        size = self.size[ids]
        return size, self.flat[np.repeat(self.start[ids] - _begins(size), size) + np.arange(int(size.sum()))]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return size, np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(size.sum()))


class Aligner:
    """A byte-level BPE file (A) beside a sentencepiece model (B)."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True):
            raise ValueError(f"{byte_level} does more than split bytes by {PATTERN}")
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        letter = byte_alphabet()
        vocab = self.a.get_vocab()
        names = [""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            names[i] = s
        self.spelt_a = Strings([bytes(letter[c] for c in s) if all(c in letter for c in s) else s.encode() for s in names])
        with open(pieces, "rb") as f:
            model = parse(f.read())
        self.b = SentencePieceProcessor(model_file=pieces)
        self.mark = self.b.piece_to_id(MARK)
        self.spelt_b = Strings([bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces])
        # places where a chunk may start: what both tokenizers' rules allow
        self.at, self.marks = (), np.zeros(256, bool)
        if separable(model) and not model.charsmap and not model.squeeze:
            known = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
            self.at = (32,) if any("\n" in p for p in known) or MARK + "a" not in known else (10, 32)
            self.marks = cutting_marks(model)
            self.marks[list(MARKS_KEPT)] = False
        # decimal numbers with what may follow them in the text of a group
        most = max(len(names), len(model.pieces))
        self.seps = most
        self.digits = Strings([str(i).encode() + s for s in (b",", b"|", b";") for i in range(most)])
        self.cache = ChunkCache(self.rows, np.uint8, most=400_000)

    def starts(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Where chunks start."""
        return cut(offsets, raw, self.at, self.marks) if self.at else np.unique(offsets[:-1][np.diff(offsets) > 0])

    def _ids_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core already
        return _flat([e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)])

    def _ids_b(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the space that begins a chunk is the mark that the library puts in front; other chunks follow text, for which an "a" stands
        first = [c[0] == " " for c in chunks]
        rows = self.b.encode([c[1:] if f else "a" + c for c, f in zip(chunks, first, strict=True)], num_threads=1)
        return _flat([(r or [self.mark]) if f else r[1:] for r, f in zip(rows, first, strict=True)])

    def rows(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of bytes for each chunk: HEAD counts (uint32), links (uint64, A id above B id), the text of its groups."""
        plain = [c.encode() for c in chunks]
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        raw = np.frombuffer(b"".join(plain), np.uint8)
        sides = []
        good = np.ones(len(chunks), bool)
        for (count, ids), spelt in ((self._ids_a(chunks), self.spelt_a), (self._ids_b(chunks), self.spelt_b)):
            width, own = spelt.spell(ids)
            of = np.repeat(np.arange(len(chunks)), count)
            total = np.bincount(of, width, len(chunks)).astype(np.int64)
            fits = total == size
            same = np.repeat(fits, total)
            wrong = own[same] != raw[np.repeat(fits, size)]
            if wrong.any():
                fits[np.repeat(np.flatnonzero(fits), size[fits])[wrong]] = False
            good &= fits
            sides.append((count, ids, width, of))
        keep = [(ids[m := good[of]], width[m]) for _, ids, width, of in sides]
        (a_ids, a_width), (b_ids, b_width) = keep
        n = int(size[good].sum())
        a, b = (Bits.of_places(np.cumsum(w) - 1, n) for w in (a_width, b_width))
        shared, either = a & b, a | b
        cuts = shared.select(np.arange(shared.count)) if shared.count else np.zeros(0, np.int64)
        a_upto, b_upto = a.rank(cuts + 1), b.rank(cuts + 1)
        place = either.places()
        links = a_ids[a.rank(place)].astype(np.uint64) << np.uint64(32) | b_ids[b.rank(place)].astype(np.uint64)
        # the text of all groups: A's tokens of a group, then B's, each with what follows it
        a_sep, b_sep = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        a_sep[a_upto - 1], b_sep[b_upto - 1] = 1, 2
        a_group, b_group = shared.rank(np.cumsum(a_width) - 1), shared.rank(np.cumsum(b_width) - 1)
        token = np.empty(len(a_ids) + len(b_ids), np.int64)
        token[np.arange(len(a_ids)) + (np.append(0, b_upto)[a_group])] = a_ids + a_sep * self.seps
        token[np.arange(len(b_ids)) + a_upto[b_group]] = b_ids + b_sep * self.seps
        letters, text = self.digits.spell(token)
        # by chunk
        ends = np.append(0, np.cumsum(size[good]))
        counts = np.full((len(chunks), HEAD), BAD, np.uint32)
        for k, bits in enumerate((a, b, shared, either)):
            counts[good, k] = np.diff(bits.rank(ends))
        tokens = np.where(good, counts[:, 0].astype(np.int64) + counts[:, 1], 0)
        n_links = np.where(good, counts[:, 3], 0).astype(np.int64)
        n_text = np.diff(np.append(0, np.cumsum(letters))[np.append(0, np.cumsum(tokens))])
        out_size = 4 * HEAD + 8 * n_links + n_text
        out = np.empty(int(out_size.sum()), np.uint8)
        begin = _begins(out_size)
        for part, at, width in ((counts.view(np.uint8).ravel(), begin, np.full(len(chunks), 4 * HEAD)), (links.view(np.uint8), begin + 4 * HEAD, 8 * n_links), (text, begin + 4 * HEAD + 8 * n_links, n_text)):
            out[np.repeat(at - _begins(width), width) + np.arange(len(part))] = part
        return out_size, out


_OPEN: dict[tuple[str, str], Aligner] = {}


def _opened(byte_level: str, pieces: str) -> Aligner:
    """This worker's aligner for two files."""
    if (byte_level, pieces) not in _OPEN:
        _OPEN[byte_level, pieces] = Aligner(byte_level, pieces)
    return _OPEN[byte_level, pieces]


class Block:
    """The texts of a column, with a space in front of each that is not empty, as numbers of distinct chunks."""

    def __init__(self, column: pa.Array, by: Aligner) -> None:
        column = pc.fill_null(column, "")
        column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
        offsets, raw = string_buffers(column)
        starts = by.starts(offsets, raw) if len(raw) else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(starts, offsets)
        self.codes, chunks = distinct(starts, raw) if len(raw) else (np.zeros(0, np.int32), pa.array([], pa.string()))
        size, flat = by.cache.store.take(by.cache.numbers(chunks)) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        begin = _begins(size)
        head = flat[(begin[:, None] + np.arange(4 * HEAD)).ravel()].view(np.uint32).reshape(-1, HEAD).astype(np.int64)
        bad = head[:, 0] == BAD
        self.head = np.where(bad[:, None], 0, head)
        self.links = self.head[:, 3]
        linked = 8 * self.links
        pick = lambda at, width: flat[np.repeat(at - _begins(width), width) + np.arange(int(width.sum()))]
        self.pairs = pick(begin + 4 * HEAD, linked).view(np.uint64)
        width = size - 4 * HEAD - linked
        text = pick(begin + 4 * HEAD + linked, width)
        self.texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(width))), pa.py_buffer(text)])
        wrong = np.append(0, np.cumsum(bad[self.codes]))
        self.good = (np.diff(wrong[self.bounds]) == 0) & (np.diff(self.bounds) > 0)

    def sums(self, of_chunk: np.ndarray) -> np.ndarray:
        """A number of each chunk, summed by text; 0 for texts without tokens."""
        total = np.append(0, np.cumsum(of_chunk[self.codes]))
        return np.where(self.good, np.diff(total[self.bounds]), 0)

    def digests(self) -> list[str]:
        """SHA-256 of the text of each text's groups."""
        whole = self.texts.take(pa.array(self.codes))
        _, at, data = whole.buffers()
        at = np.frombuffer(at, np.int64, len(whole) + 1, whole.offset * 8)[self.bounds].tolist() if len(whole) else []
        data = memoryview(data) if data is not None else b""
        return [hashlib.sha256(data[at[i] : at[i + 1] - 1]).hexdigest() if ok else "" for i, ok in enumerate(self.good)]

    def own_codes(self) -> pa.Array:
        """Chunk numbers of each text, as little-endian uint32; none for texts without tokens."""
        keep = np.repeat(self.good, np.diff(self.bounds))
        ends = np.append(0, np.cumsum(np.where(self.good, np.diff(self.bounds), 0)))
        data = self.codes[keep].astype("<u4")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.good), [None, pa.py_buffer(ends * 4), pa.py_buffer(data)]).cast(pa.binary())

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, how many links of all texts are of each, and the number of each chunk's links' pairs."""
        keep = np.repeat(self.good, np.diff(self.bounds))
        times = np.bincount(self.codes[keep], minlength=len(self.links))
        pairs, which = np.unique(self.pairs, return_inverse=True)
        return pairs, np.bincount(which, np.repeat(times, self.links), len(pairs)).astype(np.int64), which


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(df: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text (its counts, digest and chunk numbers) and one for each block (its pairs, and which of them each chunk has)."""
    df = df.select(F.col(key), F.col(text))
    own = [T.StructField("block", T.LongType()), df.schema[key], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("groups_sha256", T.StringType()), T.StructField("codes", T.BinaryType())]
    more = [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("link_sizes", T.BinaryType()), T.StructField("link_pairs", T.BinaryType())]
    schema = T.StructType([*own, *more])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, part = _opened(byte_level, pieces), TaskContext.get().partitionId()
        number = itertools.count()
        for whole in batches:
            for batch in slices(whole, text, BLOCK_BYTES):
                block, n = Block(batch.column(text), by), batch.num_rows
                name = part << 32 | next(number)
                pairs, times, which = block.pair_counts()
                counts = [pa.array(block.sums(block.head[:, k])) for k in range(HEAD)]
                kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), batch.column(key), *counts, pa.array(block.digests(), pa.string()), block.own_codes(), *(pa.nulls(n, k) for k in kinds)], schema.names)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.view(np.int64))) for x in (pairs, times)]
                sizes = [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (block.links, which)]
                empty = [pa.nulls(1, batch.schema.field(key).type), *(pa.nulls(1, pa.int64()) for _ in _COUNTS), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([name]), *empty, *lists, *sizes], schema.names)

    return df.mapInArrow(settled(work), schema)


def align(df: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of tokens, groups and links of every text, and of its links' counts in all of df.

    A's tokens are those of a space and the text by the byte-level BPE file, B's those
    of the text by the sentencepiece model, which puts the space in front itself;
    special strings are plain text. A text that is null or empty, or whose tokens of
    either side do not spell the space and the text (one with the mark U+2581), has
    no tokens: zeros, and '' for the digest; its links count nowhere. Repeated rows
    count as often as they are there. Rows come back in no order, one for each of df,
    with key and the results only. Ties for a B id's highest count all count.

    Texts and their chunks are read once and written as blocks; pairs are shuffled
    once by pair, where each block has at most one row of a pair, so no key has more
    than a block's share; the highest counts by B id are at most the model's pieces,
    which is why they are broadcast; a block meets its own pairs again in one group
    of bounded size.
    """
    table = written(blocks(df, byte_level, pieces, key, text), "aligned-blocks")
    listed = table.filter(F.col("pairs").isNotNull())
    pair = listed.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")).filter("times > 0")
    counts = pair.groupBy("pair").agg(F.sum("times").alias("count"))
    top = counts.groupBy((F.col("pair") % (1 << 32)).alias("b")).agg(F.max("count").alias("top"))
    known = counts.withColumn("b", F.col("pair") % (1 << 32)).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    found = pair.select("block", "at", "pair").join(known, "pair").select(F.col("block").alias("of"), "at", "count", "best")
    left = table.drop("pairs", "times")
    out = T.StructType([table.schema[key], *(T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def counted(rows: pa.Table, found: pa.Table) -> pa.Table:
        is_list = pc.is_valid(rows["link_pairs"])
        sizes, which = (np.frombuffer(rows.filter(is_list)[c][0].as_buffer(), "<u4").astype(np.int64) for c in ("link_sizes", "link_pairs"))
        texts = rows.filter(pc.invert(is_list))
        ends = np.append(0, np.cumsum(sizes))
        sums = []
        codes = texts["codes"].combine_chunks()
        width = pc.binary_length(codes).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        bounds = np.append(0, np.cumsum(width))
        chunk = np.frombuffer(b"".join(codes.to_pylist()), "<u4")
        at = found["at"].to_numpy()
        for c in ("best", "count"):
            of_pair = np.zeros(int(which.max()) + 1 if len(which) else 0, np.int64)
            of_pair[at] = found[c].to_numpy()
            of_chunk = np.diff(np.append(0, np.cumsum(of_pair[which]))[ends])
            sums.append(pa.array(np.diff(np.append(0, np.cumsum(of_chunk[chunk]))[bounds])))
        return pa.Table.from_arrays([texts[key], *(texts[c] for c in _COUNTS), *sums, texts["groups_sha256"]], out.names)

    return left.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(counted, out)
