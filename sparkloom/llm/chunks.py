"""Cut texts where no tokenizer rule can see across, and encode each distinct chunk once.

A chunk starts at every space or newline that follows a character which is not
white space and, if asked for, at every ASCII mark (but those of MARKS_KEPT) after
a letter of ASCII or Latin-1. The tokenizers served here never join a token, or look ahead or
back, over such a place (each states why), so a text's tokens are those of its
chunks in order. Arrow buffers are cut without a copy, distinct chunks are found
by Arrow's hashing, and only those that the worker has not met are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.llm.wordhash import BASE, INVERSE, mix

#: Marks that no cut is made at: they may belong to a contraction or stand inside a special string.
MARKS_KEPT = b"'|>"
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b not in MARKS_KEPT]] = True
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
#: Texts worked on at a time, in bytes, so that long texts do not pile up in memory.
SLICE_BYTES = 5 << 20


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return offsets - lo, raw


def _wide_space_ends(raw: np.ndarray) -> np.ndarray:
    """True at the last byte of each white-space character outside ASCII, and of U+2581, the mark that stands for a space."""
    out = np.zeros(len(raw), bool)
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    two = lead[(raw[lead] == 0xC2) & (lead + 1 < len(raw))]
    two = two[(raw[two + 1] == 0x85) | (raw[two + 1] == 0xA0)]
    out[two + 1] = True
    three = lead[(raw[lead] != 0xC2) & (lead + 2 < len(raw))]
    a, b, c = raw[three], raw[three + 1], raw[three + 2]
    hit = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hit |= (a == 0xE2) & (b == 0x96) & (c == 0x81)
    out[three[hit] + 2] = True
    return out


def cut(offsets: np.ndarray, raw: np.ndarray, at: tuple[int, ...] = (10, 32), marks: bool | np.ndarray = False) -> np.ndarray:
    """Sorted chunk starts: every text's start and every place where a chunk may start.

    marks: whether to cut at marks after letters, or at which bytes (256 flags).
    """
    space, wide = _ASCII_SPACE[raw], bool(len(raw)) and raw.max() >= 0xC2
    if wide:
        space |= _wide_space_ends(raw)
    start = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        begins = np.zeros(256, bool)
        begins[list(at)] = True
        start[1:-1] = begins[raw[1:]] & ~space[:-1]
        if marks is not False:
            letter = _LETTER[raw[:-1]]
            if wide:  # the second byte of a letter from U+00C0 to U+00FF, which all are but two signs
                last = np.flatnonzero(raw[:-1] == 0xC3) + 1
                last = last[last < len(letter)]
                letter[last[(raw[last] != 0x97) & (raw[last] != 0xB7)]] = True
            start[1:-1] |= (_MARK if marks is True else marks)[raw[1:]] & letter
    start[offsets] = True
    start[len(raw)] = False
    return np.flatnonzero(start)


def distinct(starts: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each chunk's number among the distinct chunks, and those chunks."""
    bounds = np.append(starts, len(raw)).astype(np.int32)
    col = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw))
    coded = col.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Ragged:
    """Rows of unequal length in one flat array that grows."""

    def __init__(self, kind: type) -> None:
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.rows = 0

    def extend(self, sizes: np.ndarray, values: np.ndarray) -> None:
        n, m = len(sizes), len(values)
        while self.rows + n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.start[self.rows : self.rows + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.rows : self.rows + n] = sizes
        self.flat[self.used : self.used + m] = values
        self.rows, self.used = self.rows + n, self.used + m

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and values of the rows, one after another."""
        size = self.size[rows].astype(np.int64)
        total = int(size.sum())
        at = np.repeat(self.start[rows] - (np.cumsum(size) - size), size)
        at += np.arange(total)
        return size, self.flat[at]


def string_hashes(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, by its bytes and its length."""
    offsets, raw = string_buffers(column)
    power, back = (np.full(len(raw) + 1, x, np.uint64) for x in (BASE, INVERSE))
    power[0] = back[0] = 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:-1], out=total[1:])
    size = np.diff(offsets).astype(np.uint64)
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * np.cumprod(back)[offsets[:-1]] + size)


class HashIndex:
    """Rows by 64-bit hash, in one table of open addresses that is read and filled for whole arrays at a time."""

    def __init__(self, most: int) -> None:
        self.slot = np.full(1 << (2 * most).bit_length(), -1, np.int32)
        self.hashes = np.zeros(most, np.uint64)
        self.rows = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        mask = len(self.slot) - 1
        at, out = (hashes & np.uint64(mask)).astype(np.int64), np.full(len(hashes), -1, np.int64)
        live = np.arange(len(hashes))
        while len(live):
            row = self.slot[at[live]]
            same = (row >= 0) & (self.hashes[row] == hashes[live])
            out[live[same]] = row[same]
            live = live[(row >= 0) & ~same]
            at[live] = (at[live] + 1) & mask
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Rows for the hashes, after those that are there."""
        mask, rows = len(self.slot) - 1, np.arange(self.rows, self.rows + len(hashes))
        self.hashes[rows] = hashes
        at, live = (hashes & np.uint64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(live):
            free = live[self.slot[at[live]] < 0]
            self.slot[at[free]] = rows[free]  # of several that want a slot the last has it
            live = live[self.slot[at[live]] != rows[live]]
            at[live] = (at[live] + 1) & mask
        self.rows += len(hashes)


class ChunkCache:
    """What a worker has encoded: the first `most` distinct chunks stay, later ones last for one call.

    encode(list of chunks) returns their sizes and their values, one after another.
    prepare(distinct chunks) may map chunks that encode alike to one form first.
    Forms are found by hash and compared with the form that is kept, so two of
    one hash are not taken for each other: the later one is encoded at each call.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        kind: type,
        prepare: Callable[[pa.Array], pa.Array] | None = None,
        most: int = 600_000,
    ) -> None:
        self.encode, self.kind, self.prepare, self.most = encode, kind, prepare, most
        self.forms = pa.array([], pa.large_string())
        self.index = HashIndex(most)
        self.store = Ragged(kind)
        self.kept = (0, 0)

    def numbers(self, chunks: pa.Array) -> np.ndarray:
        """Rows of self.store for the chunks, encoding those not met before."""
        forms = (self.prepare(chunks) if self.prepare else chunks).cast(pa.large_string())
        self.store.rows, self.store.used = self.kept
        hashes = string_hashes(forms)
        out = self.index.find(hashes)
        met = np.flatnonzero(out >= 0)
        same = pc.equal(self.forms.take(pa.array(out[met])), forms.take(pa.array(met)))
        out[met[~same.to_numpy(zero_copy_only=False)]] = -1
        if len(new := np.flatnonzero(out < 0)):
            fresh = forms.take(pa.array(new)).dictionary_encode()
            code = fresh.indices.to_numpy(zero_copy_only=False)
            first = self.store.rows
            sizes, values = self.encode(fresh.dictionary.to_pylist())
            self.store.extend(sizes, values)
            out[new] = first + code
            if room := max(0, min(self.most - len(self.forms), len(sizes))):
                self.forms = pa.concat_arrays([self.forms, fresh.dictionary.slice(0, room)])
                own = np.zeros(len(sizes), np.uint64)
                own[code] = hashes[new]
                self.index.add(own[:room])
                self.kept = first + room, self.store.used - len(values) + int(sizes[:room].sum())
        return out


def encode_column(column: pa.Array | pa.ChunkedArray, cache: ChunkCache) -> tuple[np.ndarray, np.ndarray]:
    """Sizes by text and the values of all texts, one after another; for tokenizers that part letters from stops."""
    offsets, raw = string_buffers(column)
    if not len(raw):
        return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, cache.kind)
    starts = cut(offsets, raw, marks=True)
    codes, chunks = distinct(starts, raw)
    size, values = cache.store.take(cache.numbers(chunks)[codes])
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.diff(ends[np.searchsorted(starts, offsets)]), values


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> list[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text; a longer text is alone."""
    n = batch.num_rows
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.diff(group, prepend=-1)) if n else np.zeros(0, int)
    return [batch.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]
