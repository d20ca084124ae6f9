"""Token ids of whole texts by the tokenizers library, each distinct chunk encoded once.

For tokenizers that drop white space and match no word across it. Texts are cut
in front of spaces, newlines and marks after letters, so a chunk holds every special string whole
(no such place lies inside one) and is normalised as it would be in its text: neither
NFC composition nor lower-casing by character looks across such a place.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.chunks import ChunkCache, encode_column, slices
from sparkloom.llm.common import settled
from sparkloom.llm.prefix_tokens import byte_alphabet

_CACHE: dict[str, ChunkCache] = {}


# The normaliser and the splitter that the short way of `_plain` is right for.
_NORMALISER = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that the model gets at a time, as one text.
_WORDS = 500


def _prepare(chunks: pa.Array) -> pa.Array:
    """Forms with the same ids: without outer spaces, and small letters in chunks of ASCII only that hold no special string.

    Others stay as they are: NFC comes before lower-casing, and a capital need not compose with a mark where its small letter does.
    """
    bare = pc.ascii_trim(chunks, " \n")
    whole = pc.or_(pc.match_substring(bare, "<|"), pc.invert(pc.string_is_ascii(bare)))
    return pc.if_else(whole, bare, pc.ascii_lower(bare))


def _plain(chunk: str) -> str | None:
    """The chunk as a small word, if it is one word of the splitter and NFC changes nothing in it (as in all text below U+0300); else None."""
    if chunk.isascii():
        if chunk.isalpha():
            return chunk.lower()
        return chunk if chunk and not any(c.isalnum() or c <= " " or c == "\x7f" for c in chunk) else None
    if chunk.isalpha() and max(chunk) < "\u0300":
        small = chunk.lower()
        return small if max(small) < "\u0300" else None
    return None


def _checked(path: str) -> None:
    """Raise if the file's steps are not those that chunks and plain words are cut for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    patterns = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if steps != _NORMALISER or patterns != [_PATTERN, None] or spec["model"].get("end_of_word_suffix") is None:
        raise ValueError(f"{path} has other steps than this encoder knows")


def chunk_cache(path: str) -> ChunkCache:
    """This worker's cache for a tokenizer file."""
    if path not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core already
        from tokenizers import Tokenizer, pre_tokenizers

        _checked(path)
        whole = Tokenizer.from_file(path)
        words = Tokenizer(whole.model)
        words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = {b: c for c, b in byte_alphabet().items()}
        # a word's last token, and no other, ends in the suffix
        suffix, vocab = whole.model.end_of_word_suffix, whole.get_vocab(with_added_tokens=False)
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

        def ids_of(texts: list[str], by: Tokenizer) -> list[np.ndarray]:
            return [np.array(e.ids, np.uint32) for e in by.encode_batch_fast(texts, add_special_tokens=False)]

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            small = [_plain(c) for c in chunks]
            own, other = ([i for i, w in enumerate(small) if (w is None) == slow] for slow in (False, True))
            sizes, parts = np.zeros(len(chunks), np.int64), []
            spelt = [w if (w := small[i]).isascii() else w.encode().decode("latin-1").translate(letters) for i in own]
            if own:
                parts += ids_of([" ".join(spelt[k : k + _WORDS]) for k in range(0, len(spelt), _WORDS)], words)
                sizes[own] = np.diff(np.flatnonzero(last[np.concatenate(parts)]), prepend=-1)
            for k in range(0, len(other), 4_000):
                rows = ids_of([chunks[i] for i in other[k : k + 4_000]], whole)
                sizes[other[k : k + 4_000]] = list(map(len, rows))
                parts += rows
            flat = np.concatenate([*parts, np.zeros(0, np.uint32)])
            order = np.array(own + other, np.int64)  # the parts' order; put back into that of the chunks
            first = np.empty(len(chunks), np.int64)
            first[order] = np.cumsum(sizes[order]) - sizes[order]
            begin = np.cumsum(sizes) - sizes
            return sizes, flat[np.repeat(first - begin, sizes) + np.arange(len(flat))]

        _CACHE[path] = ChunkCache(encode, np.uint32, _prepare)
    return _CACHE[path]


def packed(size: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary array with each row's values."""
    width = values.dtype.itemsize
    ends = np.concatenate([[0], np.cumsum(size)]) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def with_end(size: np.ndarray, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with one more value each."""
    ends = np.cumsum(size + 1) - 1
    out = np.empty(len(values) + len(size), values.dtype)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body] = values
    out[ends] = end
    return size + 1, out


def encode_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """key and ids (binary, little-endian uint32) of each row: the text's ids, then `end`.

    A null or empty text has the end id only. Row by row, no shuffle.
    """
    df = df.select(key, text)
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_cache(tokenizer)
        for whole in batches:
            for batch in slices(whole, text):
                size, ids = with_end(*encode_column(batch.column(text), cache), end)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(size), packed(size, ids.astype("<u4"))], [key, "n_tokens", "ids"])

    return df.mapInArrow(settled(work), schema)
