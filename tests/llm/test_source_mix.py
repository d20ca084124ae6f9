"""Entropy balancing against SQL, against a plain solve, and on skew and edge cases."""

import math
import re

from pyspark.sql import functions as F

from sparkloom.llm import queries, source_mix
from tests.compare import SMALL, duck_rows, rows_of


def plain_targets(words, weights=(5, 2, 1), share=1.5, most=2):
    """Sharing by hand: a list of words by source, in order."""
    w = [weights[i % len(weights)] for i in range(len(words))]
    left, out, live = share * sum(words), [0.0] * len(words), set(range(len(words)))
    while live:
        part = {i: left * w[i] / sum(w[j] for j in live) for i in live}
        over = [i for i in live if part[i] >= most * words[i]]
        if not over:
            for i in live:
                out[i] = part[i]
            break
        for i in over:
            out[i] = most * words[i]
            left -= out[i]
            live.discard(i)
    return out


def plain_rates(sizes, target, most=2):
    """Rates of least relative entropy by halving the multiplier's bracket."""
    mean = sum(sizes) / len(sizes)
    rate = lambda t, s: most / (1 + (most - 1) * math.exp(-max(-600.0, min(600.0, t * s / mean))))
    lo, hi = -(2.0**15), 2.0**15
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * rate(mid, s) for s in sizes) < target else (lo, mid)
    return {s: rate(hi, s) for s in set(sizes)}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("own"), "target": F.lit(None), "u": F.lit(1), "cell": F.lit(2)})


def corpus():
    rows = [(i, "w " * (1 + i * 37 % 900), ("b", "a", "é", None)[i % 4]) for i in range(400)]
    rows += [(1000 + i, "x\ty\n" * 20, "a") for i in range(900)]  # copies: one source and size
    rows += [(5000, "v " * 60_000, "b"), (5001, None, "a"), (5002, "", None), (5003, " \t\n", "z"), (5003, " \t\n", "z"), (None, "one two", "a"), (None, "one two", "a")]
    return rows


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "CELL", 100)
    rows = corpus()
    got = source_mix.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    by = {}
    for _, t, s in rows:
        by.setdefault(s, []).append(size(t))
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, plain_targets([sum(by[s]) for s in order]), strict=True))
    for s in order:
        own = [r for r in got if r.source == s]
        assert sorted(r.size for r in own) == sorted(by[s])
        assert all(r.source_size == sum(by[s]) and math.isclose(r.target, want[s], abs_tol=1e-6) for r in own)
        taken = sum(r.size * r.copies for r in own)
        assert all(0 <= r.copies <= 2 for r in own)
        assert abs(taken - want[s]) <= 20 + 1e-4 * want[s]


def test_rates_by_size(spark, monkeypatch):
    """Before anything is mended, copies of a size are its entropy-balanced rate but for rounding."""
    monkeypatch.setattr(source_mix, "MENDS", 0)
    got = source_mix.mix(table(spark, corpus())).collect()
    for s in ("a", "b", "é", None):
        own = [r for r in got if r.source == s and r.size]
        if own[0].target < 2 * own[0].source_size:
            rate = plain_rates([r.size for r in got if r.source == s], own[0].target)
            assert all(abs(sum(r.copies for r in own if r.size == x) - sum(r.size == x for r in own) * rate[x]) <= 1.001 for x in rate if x)


def test_reruns_and_salted_joins_agree(spark, monkeypatch):
    """Neither how rows are dealt nor how many hot sizes there are changes a row."""
    df = table(spark, corpus())
    monkeypatch.setattr(source_mix, "CELL", 50)
    usual = rows_of(source_mix.digests(df))
    monkeypatch.setattr(source_mix, "MOST_HOT", 0)
    assert rows_of(source_mix.digests(df.repartition(7))) == usual


def test_edges(spark):
    df = table(spark, corpus())
    assert source_mix.mix(df.limit(0)).collect() == []
    none = source_mix.mix(df.filter("trim(coalesce(text, '')) = ''").filter("doc_id <> 5003")).collect()
    assert [(r.size, r.target, r.copies) for r in none] == [(0, 0.0, 0)] * 2
    low = source_mix.mix(df, weights=(1,), share=0.01, most=3).collect()
    want = {r.source: r.target for r in low}
    assert all(abs(sum(r.size * r.copies for r in low if r.source == s) - t) <= 40 for s, t in want.items())


def test_repeated(spark):
    df = table(spark, [(i, "a b c " * (i + 1), "s") for i in range(30)])
    mixed = source_mix.mix(df)
    out = source_mix.repeated(df, mixed)
    assert out.columns == df.columns
    assert out.agg(F.sum(source_mix.words())).first()[0] == mixed.agg(F.sum(F.col("size") * F.col("copies"))).first()[0]


def test_query_against_sql(spark):
    assert rows_of(queries.op11_source_mix(spark, SMALL)) == duck_rows(source_mix.oracle_sql())
