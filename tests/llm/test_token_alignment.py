"""Token alignment against whole texts encoded by both libraries and paired one by one."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import queries, token_alignment
from sparkloom.llm.prefix_tokens import byte_alphabet
from tests.compare import SMALL

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(texts):
    """The contract, text by text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = byte_alphabet()
    done, total = [], Counter()
    for text in texts:
        if not text:
            done.append(None)
            continue
        a = a_tok.encode(" " + text, add_special_tokens=False).ids
        b = b_tok.encode(text)
        a_bytes = [bytes(letter[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            p = b_tok.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            done.append(None)
            continue
        spans = []
        for ids, pieces in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i, x in zip(ids, pieces, strict=True):
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, links, lo = [], [], 0
        for hi in shared:
            ga, gb = ([(s, e, i) for s, e, i in own if lo <= s and e <= hi] for own in spans)
            groups.append(",".join(str(i) for *_, i in ga) + "|" + ",".join(str(i) for *_, i in gb))
            links += [(i, j) for s, e, i in ga for t, f, j in gb if s < f and t < e]
            lo = hi
        total.update(links)
        done.append((len(a), len(b), groups, links))
    top = {}
    for (_, j), c in total.items():
        top[j] = max(top.get(j, 0), c)
    out = []
    for d in done:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        out.append((a, b, len(groups), len(links), sum(total[x] == top[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


HARD = [
    None, "", " ", "  ", "\n", "\n\n x", "a", " a", "a ", "hello world", "Hello, world!  two  spaces", "x\ny\n\nz\n", "don't we'll I'M", "<|endoftext|> in text", "a<|endoftext|>b", "<s> </s> <unk> <0x41>",
    "café naïve", "café", "漢字かな", "\U0001f600\U0001f468‍\U0001f469", "mark ▁ here", "▁", "a▁b", "  wide　space", "tab\tand\rreturn\x00nul", "1234567890 3.14", "___--__", "a.b,c;d",
    "x" * 3000, "ab " * 900, "é" * 500, "�﻿", "'s 'S 'll", "word|word | word", "!!!??? ...", "\x7f\x1c\x1d\x85",
]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("block", F.lit("own")).withColumn("pairs", F.lit(1))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_alignment.align(df.repartition(3), A, B).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_hard_texts(spark):
    check(spark, HARD + HARD[9:11] * 3)


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["the", "The", " ", "  ", "\n", ".", ",", "'s", "'", "|", ">", "<", "é", "ño", "漢", "́", "▁", "123", "ing", "#", "$", "\t", " ", "\U0001f600", "A", "a", "<|endoftext|>", "tion", "-", "x" * 40]
    check(spark, ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)])


@pytest.mark.parametrize("size", [1 << 10, 1 << 16])
def test_blocks_do_not_matter(spark, monkeypatch, size):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", size)
    texts = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"])["text"].to_pylist()[:60]
    by, pair_rows = token_alignment.Aligner(A, B), Counter()
    import pyarrow as pa

    for k in range(0, 60, 7):
        block = token_alignment.Block(pa.array(texts[k : k + 7]), by)
        pairs, times, _ = block.pair_counts()
        for p, t in zip(pairs.tolist(), times.tolist(), strict=True):
            pair_rows[p] += t
    whole = token_alignment.Block(pa.array(texts), by)
    pairs, times, _ = whole.pair_counts()
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == dict(pair_rows)


def test_query(spark):
    texts = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_token_alignment(spark, SMALL).collect()}
    assert [got[i] for i in texts["doc_id"]] == brute(texts["text"])


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (None, None)], "doc_id long, text string")
    rows = token_alignment.align(df, A, B).collect()
    assert len(rows) == 4 and len({tuple(r)[1:] for r in rows}) == 2
    assert token_alignment.align(df.limit(0), A, B).collect() == []
