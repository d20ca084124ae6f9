"""Counts at every prefix against the library, on hard texts and random ones."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm.prefix_tokens import PrefixCounter, count_at, prefix_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["a  b", "a\n\n  b c", "  x  y", "I'll we're 'tis ''s 'r", "foo<|endoftext|>  bar<|endof x<|endoftext|><|endoftext|>z", "x  <|endoftext|> y", " \n \t z", "日本語 テスト 12345 ___ ..", "naïve façade 　 x", "'ll", "a'v", "a" * 40, "------====", "\x1f\x85  y"]
PARTS = ["a", "b", " ", "  ", "\n", "'", "s", "ll", "re", "1", "é", "日", "<|endoftext|>", "<|", " ", ".", "the", "tion", "ing", "\x1e"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lengths(library, texts):
    return [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix(library):
    rnd = random.Random(4)
    counter = PrefixCounter(PATH)
    for text in HARD + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]:
        assert counter.counts(text) == lengths(library, [text[:k] for k in range(1, len(text) + 1)]), text


def test_rows(spark, library):
    texts = [None, "", *HARD, "the cat " * 30_000, "x" * 100_000, HARD[0]]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in prefix_counts(df, PATH, budget=5).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        assert rows[i].n_tokens == lengths(library, [t])[0] and rows[i].n_bytes == len(t.encode())
        if len(t) < 200:
            fits = [k for k in range(len(t) + 1) if lengths(library, [t[:k]])[0] <= 5]
            assert rows[i].fit_chars == fits[-1]
    some = prefix_counts(df, PATH).filter("doc_id between 2 and 8").select("text", *(count_at("prefix_steps", k).alias(f"c{k}") for k in (0, 1, 3, 500))).collect()
    for r in some:
        assert r.c0 == 0 and r.c500 is None
        assert r.c1 == lengths(library, [r.text[:1]])[0] and (len(r.text) < 3 or r.c3 == lengths(library, [r.text[:3]])[0])
    assert prefix_counts(df.limit(0), PATH).count() == 0
    assert prefix_counts(df, PATH).agg(F.sum(F.octet_length("prefix_steps"))).first()[0] == 2 * sum(len(t or "") for t in texts)
