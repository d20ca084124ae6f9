"""Token counts at every prefix of a text, by prefix dynamic programming.

In byte-pair encoding with ranked merges, the encoding of a prefix ends in the
one token t for which (last token of the encoding of the rest, t) encodes as
itself, so count(prefix) = count(prefix without t) + 1. One pass over a word
gives the count at every place. Counts are kept as differences per code point;
truncation and budget questions then need sums only, no second encoding.

The count of a prefix is what the tokenizer gives for that prefix as a whole
text, so it can fall as a prefix grows ("th" may be two tokens, "the" one).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.chunks import ChunkCache, encode_column, slices, string_buffers
from sparkloom.llm.common import settled

# Fixed value: the split pattern of byte-level BPE with contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The pattern's words that are no run of one kind of character.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable, else 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts of single words under a byte-level BPE vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_alphabet()
        plain = lambda s: bytes(letter[c] for c in s)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.token = {}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            t = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = (rank, t)
            self.parts.setdefault(t, (rank, vocab[a], vocab[b]))
        special = {x["content"] for x in spec["added_tokens"]}
        self.specials = sorted(special, key=len, reverse=True)
        known = {plain(s): i for s, i in vocab.items() if s not in special}
        self.bytes_of = {i: b for b, i in known.items()}
        # a token that its own bytes do not encode to never appears
        self.token = {b: i for b, i in known.items() if len(b) == 1 or self._merged(b, known) == [i]}
        self.longest = max(map(len, self.token))
        self.fits: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall
        self.space = regex.compile(r"\s+").fullmatch
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if special else None

    def _merged(self, word: bytes, token: dict[bytes, int]) -> list[int]:
        """Plain encoding: merge the pair of lowest rank, leftmost first."""
        ids = [token[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min(((self.merge[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merge), default=None)
            if best is None:
                break
            (_, t), i = best
            ids[i : i + 2] = [t]
        return ids

    def _fit(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode as just a, b.

        Each stays whole unless a pair across their border is merged before one
        of the two is complete; walk back through both merge trees to look.
        """
        limit, left, right, merge, parts = 1 << 60, a, b, self.merge, self.parts
        ok = True
        while True:
            if (m := merge.get((left, right))) and m[0] < limit:
                ok = False
                break
            x, y = parts.get(left, (-1, 0, 0)), parts.get(right, (-1, 0, 0))
            if x[0] < 0 and y[0] < 0:
                break
            # undo the later of the last two merges; at a border merge of equal rank the left one came first
            if x[0] > y[0]:
                limit, left = x[0], x[2]
            else:
                limit, right = y[0] + (1 if merge.get((left, y[1]), (-1, 0))[0] == y[0] else 0), y[1]
        if len(self.fits) < 1_000_000:
            self.fits[a << 32 | b] = ok
        return ok

    def word(self, data: bytes) -> list[int]:
        """Token counts of data[:1], data[:2], ... as words of their own."""
        last, count, token, longest, fits = [-1], [0], self.token, self.longest, self.fits
        for i in range(1, len(data) + 1):
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                if (t := token.get(data[j:i])) is not None:
                    if j == 0 or (fits[p] if (p := last[j] << 32 | t) in fits else self._fit(last[j], t)):
                        last.append(t)
                        count.append(count[j] + 1)
                        break
        return count[1:]

    def _of_word(self, word: str) -> tuple[int, ...]:
        """Counts by code point of a word that is one match of the pattern."""
        if (old := self.words.get(word)) is not None:
            return old
        data = word.encode()
        by_byte = self.word(data)
        if len(data) == len(word):
            out = tuple(by_byte)
        else:
            ends = np.cumsum([len(c.encode()) for c in word])
            out = tuple(by_byte[e - 1] for e in ends)
        if word in CONTRACTIONS:  # its prefixes are an apostrophe, then letters
            for k in range(2, len(word)):
                out = (*out[: k - 1], self.word(b"'")[-1] + self.word(word[1:k].encode())[-1], *out[k:])
        if len(self.words) < 100_000:
            self.words[word] = out
        return out

    def ordinary(self, text: str) -> list[int]:
        """Counts at each code point of a text with no special string in it."""
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.word(text.encode())  # one word of the pattern
        out: list[int] = []
        words, space = self.split(text), self.space
        i, base = 0, 0
        while i < len(words):
            if not space(words[i]):
                own = self._of_word(words[i])
                out += own if not base else [base + c for c in own]
                base += own[-1]
                i += 1
                continue
            # inside a run of white space the run so far is one word, with or without what follows
            j = i
            while j < len(words) and space(words[j]):
                j += 1
            run = "".join(words[i:j])
            if j < len(words) and words[j][0] == " ":
                run += " "
                own = self._of_word(run)
                out += [base + c for c in own[:-1]]
                before = base + sum(self._of_word(w)[-1] for w in words[i:j])
                out.append(base + own[-1])
                ahead = self._of_word(words[j])
                out += [before + c for c in ahead[1:]]
                base = before + ahead[-1]
                i = j + 1
            else:
                out += [base + c for c in self._of_word(run)]
                base += sum(self._of_word(w)[-1] for w in words[i:j])
                i = j
        return out

    def counts(self, text: str) -> list[int]:
        """Counts at each code point; a whole special string is one token, a part of it plain text."""
        if self.special is None or not any(s in text for s in self.specials):
            return self.ordinary(text)
        out: list[int] = []
        base = 0
        for k, part in enumerate(self.special(text)):
            if k % 2 == 0:
                own, prior = self.ordinary(part), part
                out += [base + c for c in own]
                total = own[-1] if own else 0
                # the last word before a special string is counted as the end of its own text
                continue
            out += [base + self.ordinary(prior + part[:j])[-1] for j in range(1, len(part))]
            base += total + 1
            out.append(base)
        return out


def _encoder(counter: PrefixCounter):
    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [counter.counts(c) for c in chunks]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((x for r in rows for x in r), np.int32, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        step = np.diff(flat, prepend=0)
        has = sizes > 0
        step[first[has]] = flat[first[has]]
        return sizes, step.astype(np.int16)

    return encode


_CACHE: dict[str, ChunkCache] = {}


def _cache(path: str) -> ChunkCache:
    if path not in _CACHE:
        _CACHE[path] = ChunkCache(_encoder(PrefixCounter(path)), np.int16, most=400_000)
    return _CACHE[path]


def prefix_counts(df: DataFrame, tokenizer: str, text: str = "text", budget: int | None = None, keep_steps: bool = True) -> DataFrame:
    """Add n_tokens, n_bytes, prefix_steps and fit_chars to the rows of df.

    prefix_steps: binary, little-endian int16 for each code point, how far the
    token count of the prefix that ends there is from that of the prefix before.
    fit_chars: code points of the longest prefix of at most `budget` tokens
    (null without a budget). A null or empty text has no tokens, no bytes and an
    empty prefix_steps. Rows are kept as they are, repeated ones included; columns
    of df that bear one of the added names are replaced. Texts are cut in chunks
    before white space and before marks after letters only, where a word of the
    pattern ends whatever follows, and no special string is cut. The work is by row: no shuffle, memory bounded by SLICE_BYTES or
    the longest text.
    """
    added = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("fit_chars", T.LongType())]
    added += [("prefix_steps", T.BinaryType())] * keep_steps
    df = df.drop(*(n for n, _ in added))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer)
        for whole in batches:
            for batch in slices(whole, text):
                column = batch.column(text)
                n = batch.num_rows
                size, steps = encode_column(column, cache)
                ends = np.cumsum(size)
                total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                first = ends - size
                tokens = total[ends] - total[first]
                fit = pa.nulls(n, pa.int64())
                if budget is not None:
                    count = total[1:] - np.repeat(total[first], size)
                    good = np.flatnonzero(count <= budget)
                    last = np.searchsorted(good, ends) - 1
                    at = good[np.maximum(last, 0)] if len(good) else np.zeros(n, np.int64)
                    has = (last >= 0) & (at >= first) & (size > 0)
                    fit = pa.array(np.where(has, at - first + 1, 0))
                offsets, _ = string_buffers(column)
                new = [pa.array(np.diff(offsets)), pa.array(tokens), fit]
                if keep_steps:
                    new.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], 2 * ends])), pa.py_buffer(steps)]).cast(pa.binary()))
                names = [n for n, _ in added]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return df.mapInArrow(settled(work), schema)


def count_at(steps: str, chars: int) -> F.Column:
    """The token count of the prefix of so many code points, from prefix_steps; null beyond the text."""
    at = F.expr(
        f"case when {chars} between 0 and octet_length({steps}) / 2 then aggregate(sequence(1, {chars}), 0L, (s, i) -> s + "
        f"(conv(hex(substring({steps}, 2 * i, 1)), 16, 10) * 256 + conv(hex(substring({steps}, 2 * i - 1, 1)), 16, 10) + 32768) % 65536 - 32768) end"
    )
    return F.when(F.lit(chars) == 0, F.lit(0).cast("long")).otherwise(at.cast("long"))
