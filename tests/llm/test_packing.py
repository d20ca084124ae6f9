"""Packing against exhaustive search on small counts, and placement on rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.packing import assign, cut_pieces, plan, reduce_counts, sequences


def fewest(items, room):
    items, best, bins = sorted(items, reverse=True), [len(items)], []

    def go(i):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for k in range(len(bins)):
            if bins[k] + items[i] <= room and bins[k] not in seen:
                seen.add(bins[k])
                bins[k] += items[i]
                go(i + 1)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1)
        bins.pop()

    go(0)
    return best[0]


def test_reduction_keeps_the_optimum():
    rnd = random.Random(3)
    for _ in range(800):
        room = rnd.choice([10, 20, 50])
        items = [rnd.randint(1, room) for _ in range(rnd.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        fixed, rest = reduce_counts(dict(counts), room)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(p.bins for p in fixed) + fewest(left, room) == fewest(items, room)
        held = {}
        for p in plan(dict(counts), room):
            assert sum(p.lengths) <= room
            for s in p.lengths:
                held[s] = held.get(s, 0) + p.bins
        assert held == counts


def test_large_counts_are_near_the_bound():
    rnd = random.Random(5)
    counts = {k: rnd.randint(1, 10**6) for k in range(1, 1500)}
    least = -(-sum(k * n for k, n in counts.items()) // 4096)
    assert sum(p.bins for p in plan(counts, 4096)) <= least * 1.001
    assert plan({}, 4096) == []
    with pytest.raises(ValueError):
        plan({4097: 1}, 4096)


def test_rows_are_placed_without_gaps(spark):
    rows = [(i % 40 if i % 11 else None, i // 40, (i * 7919) % 60 + 1) for i in range(600)] + [(7, 7, 64)] * 90
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long").withColumn("ids_crc32", F.lit(0).cast("long"))
    out = assign(df, 64).toPandas()
    assert len(out) == len(rows) and sorted(out.length) == sorted(r[2] for r in rows)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 64
    assert assign(df.limit(0), 64).count() == 0


def test_long_documents_are_cut(spark):
    ids = spark.createDataFrame([(1, 10, bytes(range(40))), (2, 1, b"abcd"), (3, 4, bytes(16))], "doc_id long, n_tokens long, ids binary")
    got = cut_pieces(ids, 4)
    assert sorted((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got.collect()) == [
        (1, 0, 0, 4, bytes(range(16))), (1, 1, 4, 4, bytes(range(16, 32))), (1, 2, 8, 2, bytes(range(32, 40))), (2, 0, 0, 1, b"abcd"), (3, 0, 0, 4, bytes(16)),
    ]
    placed = assign(got.withColumn("ids_crc32", F.crc32("ids")), 4)
    whole = sequences(placed).collect()
    assert sum(r.n_tokens for r in whole) == 15 and all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_scratch_is_cleared_and_shared(spark, tmp_path, monkeypatch):
    import os

    from sparkloom.llm import common

    with monkeypatch.context() as m:
        m.setattr(common, "scratch_root", lambda s: str(tmp_path))
        m.setattr(common, "_MADE", [])
        assert common.written(spark.range(3), "a").count() == 3 and len(os.listdir(tmp_path)) == 1
        common.clear_scratch(spark)
        assert not os.listdir(tmp_path)

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://head:7077"

    try:
        common.scratch_root(Cluster)
    except ValueError:
        return
    raise AssertionError("a machine's own folder on a cluster")
