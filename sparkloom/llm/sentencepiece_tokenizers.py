"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here: pieces, scores and kinds, the normaliser's
character map and options. From it a tokenizer is rebuilt: normaliser, the mark
for a space in front of each word, byte fallback, and either the unigram scores
or, for models of the merging kind, the merges that the scores rank. Its ids are
what is returned. Each distinct chunk is also encoded by the sentencepiece library;
where the two differ (runs of marks, whose scores tie, can), the chunk has no parity
and takes the library's ids.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.chunks import ChunkCache, cut, distinct, slices, string_buffers
from sparkloom.llm.common import settled
from sparkloom.llm.wordids import packed

# The mark that stands for a space; piece kinds; model kinds.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, MERGES = 1, 2


@dataclass
class Model:
    """What a model file says that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire in (1, 2, 5):
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire}")


def parse(data: bytes) -> Model:
    """The model in a file's bytes. Field numbers are those of the public sentencepiece_model.proto."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, model.kind), bool(spec.get(35, model.byte_fallback))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, model.charsmap)
            model.dummy_prefix, model.squeeze, model.escape = bool(spec.get(3, model.dummy_prefix)), bool(spec.get(4, model.squeeze)), bool(spec.get(5, model.escape))
    return model


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The pairs that make up each piece, the best-scored piece first, in order of the parts' ids within one."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    out = []
    for p, i in ids.items():
        score = pieces[i][1]
        out += [(-score, ids[p[:k]], ids[p[k:]], (p[:k], p[k:])) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    return [m for *_, m in sorted(out)]


def build(model: Model, prefix: bool = True):
    """A tokenizers.Tokenizer that gives the model's ids of texts without user-defined pieces; without `prefix`, of what follows other text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        # only normal pieces are made from text; the others keep their ids, at scores that no way takes
        low = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0) - 1e4
        core = models.Unigram([(p, s if k == NORMAL else low) for p, s, k in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == MERGES:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges_of(model.pieces), unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind}")
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


class Rebuilt:
    """The model on the tokenizers library, user-defined pieces included: each is one id, and text between them is encoded for itself."""

    def __init__(self, model: Model) -> None:
        self.first, self.later, self.squeeze = build(model), build(model, prefix=False), model.squeeze
        self.user = {p.replace(MARK, " ") if model.escape else p: i for i, (p, _, k) in enumerate(model.pieces) if k == USER}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")").split if self.user else None

    def _ids(self, texts: list[str], by) -> list[list[int]]:
        return [e.ids for e in by.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], later: bool = False) -> list[list[int]]:
        """Ids of each text, a batch on all of the task's threads; `later`: texts that follow other text, so no mark is put in front."""
        if self.parts is None or not any(u in t for t in texts for u in self.user):
            return self._ids(texts, self.later if later else self.first)
        cut = [self.parts(t) for t in texts]
        heads = self._ids([c[0] for c in cut], self.later if later else self.first)
        if not later and len(mark := self._ids(["a"], self.first)[0]) and not self.squeeze:
            # in front of a user-defined piece that begins the text the mark stands alone
            alone = mark[:1] if self.first.id_to_token(mark[0]) == MARK else [self.first.token_to_id(MARK)]
            heads = [alone if not c[0] and len(c) > 1 and alone[0] is not None else h for c, h in zip(cut, heads, strict=True)]
        rest = [p for c in cut for p in c[2::2]]
        tails = iter(self._ids(rest, self.later))
        return [[*h, *(x for u in c[1::2] for x in (self.user[u], *next(tails)))] for c, h in zip(cut, heads, strict=True)]

    def decode(self, rows: list[list[int]]) -> list[str]:
        """Texts of ids."""
        return self.first.decode_batch(rows, skip_special_tokens=False)


def separable(model: Model) -> bool:
    """Whether no piece has a mark after another character, so that a text's words are encoded each for itself."""
    return model.dummy_prefix and model.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER)) and not any(" " in p for p, _, _ in model.pieces)


def cutting_marks(model: Model) -> np.ndarray:
    """Flags of the ASCII marks that stand behind a letter in no piece, and so begin a piece there. (Before one "a" stands for the text.)"""
    out = np.zeros(256, bool)
    known = {p for p, _, kind in model.pieces if kind == NORMAL}
    if separable(model) and not model.charsmap and not model.squeeze and MARK + "a" in known:
        out[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) in known]] = True
        for p, _, kind in model.pieces:
            if kind in (NORMAL, USER):
                out[[ord(b) for a, b in zip(p, p[1:], strict=False) if a.isalpha() and b.isascii()] + [ord(c) for c in p if kind == USER and c.isascii()]] = False
    return out


_OPEN: dict[str, tuple] = {}


def _opened(path: str) -> tuple:
    """This worker's tokenizer, cache, whether words are cut apart, and at which marks, for a model file."""
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # batches are encoded on all of the task's threads
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = parse(f.read())
        tok, lib = Rebuilt(model), SentencePieceProcessor(model_file=path)
        words, marks = separable(model), cutting_marks(model)

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # a chunk begins with a space, which is what the mark in front of a text stands for, or follows a letter
            later = [i for i, c in enumerate(chunks) if c[0] != " "]
            first = [i for i, c in enumerate(chunks) if c[0] == " "]
            texts = [chunks[i][1:] for i in first] + [chunks[i] for i in later]
            own = tok.encode(texts[: len(first)]) + tok.encode(texts[len(first) :], later=True)
            theirs = lib.encode(texts[: len(first)] + ["a" + t for t in texts[len(first) :]], num_threads=1)
            theirs[len(first) :] = [x[1:] for x in theirs[len(first) :]]
            if words and not model.squeeze and "" in texts:  # a space that ends a text is a mark, an empty text is nothing
                k = texts.index("")
                own[k], theirs[k] = [tok.first.token_to_id(MARK)], [lib.piece_to_id(MARK)]
            back = tok.decode(theirs)
            same = [a == b for a, b in zip(own, theirs, strict=True)]
            flags = np.fromiter(((s | 2 * (t == d)) for s, t, d in zip(same, texts, back, strict=True)), np.uint32, len(texts))
            rows = [a if s else b for s, a, b in zip(same, own, theirs, strict=True)]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter(itertools.chain.from_iterable(rows), np.uint32, int(sizes.sum()))
            heads = np.cumsum(sizes) - sizes
            flat = np.insert(flat, heads, flags)  # each chunk's flags, then its ids
            order = np.empty(len(rows), np.int64)
            order[first + later] = np.arange(len(rows))
            at = (heads + np.arange(len(rows)))[order]
            sizes = sizes[order] + 1
            return sizes, flat[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))]

        _OPEN[path] = tok, ChunkCache(encode, np.uint32), words, marks
    return _OPEN[path]


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids (binary, little-endian uint32), parity and round_trip to df; rows and order stay, no shuffle.

    ids are the rebuilt tokenizer's, in chunks without parity the library's;
    parity: both agree on all of the text; round_trip: decoding the ids
    gives the text (it need not, where the model's normaliser changes texts or a
    character has no piece). A null or empty text has no ids and is true in both.
    Columns of df with these names are replaced. Texts are cut in words if no piece
    of the model spans words, and at marks that follow letters in no piece; else
    each distinct text is a chunk.
    """
    added = [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("parity", T.BooleanType()), ("round_trip", T.BooleanType())]
    df = df.drop(*(n for n, _ in added))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache, words, marks = _opened(path)
        for whole in batches:
            for b in slices(whole, text):
                col = pc.fill_null(b.column(text), "")
                col = pc.if_else(pc.equal(col, ""), "", pc.binary_join_element_wise(" ", col, ""))
                offsets, raw = string_buffers(col)
                if len(raw):
                    starts = cut(offsets, raw, (32,), marks) if words else np.unique(offsets[:-1][np.diff(offsets) > 0])
                    codes, chunks = distinct(starts, raw)
                    size, flat = cache.store.take(cache.numbers(chunks)[codes])
                else:
                    starts, size, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
                bounds = np.searchsorted(starts, offsets)
                heads = np.cumsum(size) - size
                flags = flat[heads]
                ids = np.delete(flat, heads) if len(heads) else flat
                ends = np.concatenate([[0], np.cumsum(size - 1)])
                tokens = np.diff(ends[bounds])
                bad = [np.concatenate([[0], np.cumsum((flags & bit) == 0)]) for bit in (1, 2)]
                good = [pa.array(np.diff(x[bounds]) == 0) for x in bad]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens), packed(tokens, ids.astype("<u4")), *good], schema.names)

    return df.mapInArrow(settled(work), schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add decoded, the text of the binary column `ids`, to df; null stays null."""
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, *_ = _opened(path)
        for b in batches:
            rows = b.column(ids).to_pylist()
            texts = tok.decode([np.frombuffer(r or b"", "<u4").tolist() for r in rows])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], pa.string())], schema.names)

    return df.mapInArrow(settled(work), schema)
