"""The join against SQL and against all pairs, with classes too large and too alike to split."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import jaccard_join as J
from sparkloom.llm import queries as Q
from tests.compare import SMALL, duck_rows, rows_of


MANY = 1 << 40


def nodes(df):
    return J.sketches(df).filter("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("w"), F.first("n").alias("n"), F.first("sig").alias("sig"))


def all_pairs(rows):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    near = [[i != j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and bool(sets[i]) and bool(sets[j]) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if near[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append(str((rows[i][0], min(ids) if ids else None, sum(near[i]))))
    return sorted(out)


def got(df):
    return sorted(str((r.doc_id, r.class_id, r.n_links)) for r in J.join(df).collect())


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(90)]
    rows = [(i, " ".join(word() if k == i * 13 % 90 or k == i * 29 % 90 else base[k] for k in range(90))) for i in range(45)]
    shared = [word() for _ in range(30)]
    rows += [(100 + i, " ".join(shared + [word() for _ in range(rnd.randint(0, 40))])) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "one"), (205, "one two"), (206, "a b c d e"), (206, "a b  c d\te"), (None, "a b c d e"), (None, "zz yy xx ww vv uu"), (7, rows[7][1])]
    return rows


def test_all_pairs(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    want = all_pairs(rows)
    assert got(df) == want
    assert J.join(df.limit(0)).count() == 0
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "CHUNK_NODES", 7)
    monkeypatch.setattr(J, "MAP_LEAST", MANY)
    assert got(df) == want  # by splits, tight buckets in several cells, and rows found by a join
    monkeypatch.setattr(J, "TIGHT", 2.0)
    monkeypatch.setattr(J, "DEPTH", 2)
    took, plain = [], J._runs
    monkeypatch.setattr(J, "_runs", lambda pool, every, runs: took.append((runs, pool.count())) or plain(pool, every, runs))
    leaf = J.leaves(nodes(df)).toPandas()
    assert leaf["size"].max() > 4  # split to the greatest depth
    # all nodes take the runs of one split and one more, those of buckets that were split in most runs take those of three
    assert [r for r, _ in took] == [range(0, J.runs_needed(1) + 1), range(J.runs_needed(1) + 1, J.runs_needed(3))] and took[0][1] > took[1][1] > 0


def test_leaves_of_all_depths_are_read_by_few_scans(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in corpus() if i is not None and i < 45], "doc_id long, text string")
    for name, value in (("SMALL", 4), ("TIGHT", 2.0), ("DEPTH", 2), ("runs_needed", lambda splits, target=0.9: 1)):
        monkeypatch.setattr(J, name, value)
    taken, plain = [], J._runs
    monkeypatch.setattr(J, "_runs", lambda pool, every, runs: taken.append(runs) or plain(pool, every, runs))
    leaf = J.leaves(nodes(df))
    # the driver holds the plan and its stages: two tables for each time that runs are taken, not some for each depth
    assert leaf._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2 * len(taken)
    assert leaf.filter("size > 4").count() > 0 and leaf.groupBy("leaf").agg(F.max("size").alias("s"), F.countDistinct("node").alias("n")).filter("s <> n").count() == 0


def test_bound_by_node(spark):
    ways = [(b"a", 0, 2), (b"a", 0, 4), (b"a", 3, 3), (b"b", 1, 9), *((b"c", r, 5) for r in range(12))]
    got = {bytes(r.node): (r.splits, r.missed) for r in J._missed_by_node(spark.createDataFrame(ways, "node binary, way int, splits int"), 6).collect()}
    want = {b"a": (4, J.missed([4, 3] + [1] * 10)), b"b": (9, J.missed([9] + [1] * 11)), b"c": (5, J.missed([5] * 12))}
    assert all(got[k][0] == s and abs(got[k][1] - m) < 1e-12 for k, (s, m) in want.items()) and got.keys() == want.keys()


def test_keeps_one_of_each_class(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in [*rows, rows[3], rows[3]]], "doc_id long, text string, extra string")
    kept = J.keep_one(df)
    assert kept.columns == ["doc_id", "text", "extra"]
    classes = {r.class_id for r in J.join(df).filter("n_links > 0").collect()} | {r.doc_id for r in J.join(df).filter("n_links = 0").collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in classes if i is not None)
    assert J.keep_one(df.limit(0)).count() == 0
    monkeypatch.setattr(J, "MAP_BITS", 1 << 6)  # a map in which nearly every row seems to be wanted
    monkeypatch.setattr(J, "MAP_LEAST", 0.1)
    assert rows_of(J.keep_one(df)) == rows_of(kept)
    monkeypatch.setattr(J, "MAP_LEAST", MANY)
    assert rows_of(J.keep_one(df)) == rows_of(kept)


def test_ids_of_other_types(spark):
    rows = corpus()
    want = all_pairs(rows)
    for kind in ("int", "string"):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        assert got(df) == want, kind
        kept = J.keep_one(df)
        assert kept.schema == df.schema and kept.count() == J.keep_one(df.withColumn("doc_id", F.col("doc_id").cast("long"))).count(), kind


def test_against_sql(spark):
    assert rows_of(Q.op10_jaccard_join(spark, SMALL)) == duck_rows(J.oracle_sql())


def test_intersections(monkeypatch):
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(0, 40)).astype(np.uint64)) for _ in range(50)]
    left, right = np.arange(30), np.arange(20, 50)
    out = J._common(sets, left, right)
    assert all(out[a, b] == len(np.intersect1d(sets[i], sets[j])) for a, i in enumerate(left) for b, j in enumerate(right))


def test_runs_and_shingles():
    assert all(J.missed([d] * 2 * J.runs_needed(d)) <= 1 - J.TARGET_RECALL < J.missed([d] * 2 * (J.runs_needed(d) - 1)) for d in range(1, J.DEPTH + 2))
    assert J.runs_needed(3) > J.runs_needed(1, 0.9) == 1
    count, value = J.shingles(pa.array(["a b c d e f", "a b c d e", None, "", "a", "a b c d e f a b c d e"]))
    assert list(count) == [2, 1, 0, 0, 1, 6]
    assert value[2] in value[:2]
