"""Ids against the library; files against their source."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import chunks, huffman
from sparkloom.llm import queries as Q
from sparkloom.llm.chunks import encode_column
from sparkloom.llm.wordids import chunk_cache, encode_documents
from tests.compare import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")
# Capitals whose small letters only compose with the mark that follows.
CAPITALS = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
PARTS = ["a", "B", " ", "  ", "\n", "'", "s", "LL", "re", "1", "é", "é", "́", "日", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", " ", ".", "The", "tion", "　", "\t", "Σ", "ΟΔΟΣ", "ẞ", "İ", "\x85", "\x1f", "‍", *CAPITALS, "#", "&&", "\u0308", "|", ">", "-", "_", "ª", "ÿ", "×", "÷", "É", "ñ"]


def test_ids_are_the_librarys():
    rnd = random.Random(1)
    texts = [*CAPITALS, *("".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(9000))]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 127), rnd.randint(160, 0x24F), rnd.randint(0x300, 0x36F), 32])) for _ in range(rnd.randint(1, 20))) for _ in range(6000)]
    size, ids = encode_column(pa.array(texts), chunk_cache(PATH))
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in np.split(ids, np.cumsum(size)[:-1])] == want


def test_hash_collisions_and_full_caches(monkeypatch):
    """Chunks of one hash are not taken for each other, and what does not stay is encoded again."""
    calls = []

    def encode(words):
        calls.append(list(words))
        return np.array(list(map(len, words))), np.array([ord(c) for w in words for c in w])

    for most, hashes in ((100, chunks.string_hashes), (2, chunks.string_hashes), (100, lambda x: np.zeros(len(x), np.uint64))):
        monkeypatch.setattr(chunks, "string_hashes", hashes)
        cache = chunks.ChunkCache(encode, np.int64, most=most)
        for words in (["a", "bb", "a", ""], ["ccc", "bb"], ["d", "ccc", "a"], []):
            size, values = cache.store.take(cache.numbers(pa.array(words, pa.string())))
            assert [list(x) for x in np.split(values, np.cumsum(size)[:-1])][: len(words)] == [list(map(ord, w)) for w in words]


def test_registered_ids_are_the_librarys(spark):
    """op5, op8 and op2 as registered, on whole texts."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    lib, byte = Tokenizer.from_file(PATH), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    start = dict(zip(sorted(ids), np.cumsum([0, *(len(ids[i]) for i in sorted(ids))])))
    got = Q.op5_huffman_ids(spark, SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, start[i], len(x), zlib.crc32(x.tobytes())) for i, x in ids.items())
    placed = Q.op8_best_fit_packing(spark, SMALL).collect()
    want = [(i, k, k * 4096, len(x[k * 4096 : k * 4096 + 4096]), zlib.crc32(x[k * 4096 : k * 4096 + 4096].tobytes())) for i, x in ids.items() for k in range(-(-len(x) // 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == sorted(want)
    full: dict[int, int] = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 4096
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op2_token_counts(spark, SMALL).collect()}
    for i, t in docs.items():
        n = len(byte.encode(t, add_special_tokens=False).ids)
        assert counts[i] == (len(t.encode()), n, n > 1024)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=30), min_size=1, max_size=6), st.lists(st.integers(1, 10**6), min_size=41, max_size=41))
def test_codes_round_trip(docs, counts):
    lengths = huffman.code_lengths(np.array(counts), 16)
    assert sum(2.0 ** -int(n) for n in lengths) == 1.0 and lengths.max() <= 16
    size = np.array(list(map(len, docs)))
    ids = np.array([x for d in docs for x in d], np.int64)
    n_bytes, bits, inside = huffman.encode(size, ids, lengths, huffman.canonical(lengths))
    data = huffman.image(np.arange(len(docs)), np.ones(len(docs)), size, n_bytes, np.zeros(0), bits.tobytes())
    _, _, got, out = huffman.open_image(data, *huffman.table(lengths))
    assert list(got) == list(size) and list(out) == list(ids)


def test_lengths_are_least():
    """Against plain Huffman where the limit does not bind, and Kraft's bound where it does."""
    import heapq

    rnd = np.random.default_rng(2)
    for _ in range(50):
        c = rnd.integers(1, 1000, rnd.integers(2, 30))
        heap = [(int(x), i, 0) for i, x in enumerate(c)]
        heapq.heapify(heap)
        total = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            total += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], 0, 0))
        assert int((huffman.code_lengths(c) * c).sum()) == total
    steep = np.array([2**k for k in range(30)])
    assert huffman.code_lengths(steep).max() == huffman.LIMIT


def test_files(spark, tmp_path):
    lib = Tokenizer.from_file(PATH)
    texts = [None, "", "one two", "a very " * 3000, "x", "one two", "ÀÉ ß", "longer text with words"]
    ids = [5, 3, 9, -2, 7, 9, None, 100]
    df = spark.createDataFrame(list(zip(ids, texts, ["q"] * 8)), "doc_id long, text string, ids string")
    enc = encode_documents(df, PATH).cache()
    huffman.write(enc, f"{tmp_path}/h")
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in huffman.read(spark, f"{tmp_path}/h").collect()]
    want = [(i, np.array([*(lib.encode(t or "", add_special_tokens=False).ids), 1], "<u4").tobytes()) for i, t in zip(ids, texts)]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), zlib.crc32(x[1])))
    got.sort(key=lambda x: x[1])
    assert [(k, b) for k, _, _, b in got] == want
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1]]
    huffman.write(enc.limit(0), f"{tmp_path}/none")
    assert huffman.read(spark, f"{tmp_path}/none").count() == 0
