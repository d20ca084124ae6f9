"""Rules against plain Python and numpy; the classifier on held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import knn_quality, quality_rules
from sparkloom.llm import queries as Q
from sparkloom.sources import read_table
from tests.compare import SMALL, duck_rows, rows_of


def by_hand(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = {}
    for k in range(len(w) - 2):
        tri.setdefault(tuple(w[k : k + 3]), []).append(k)
    twice = {i for at in tri.values() if len(at) > 1 for k in at for i in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice)


TEXTS = [None, "", "one", "a b c a b c", "a a a a", "x\nx\n\n \nx\ny", "é日 #$|<> & \x0b\x0c\r\ttab", "p q r s p q r t q r s", "w " * 5000, "a b c", "ab\x1cc d"]


def test_statistics(spark):
    df = spark.createDataFrame([(i, t, None, "s", 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_words int")
    rows = quality_rules.text_statistics(df).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: by_hand(t) for i, t in enumerate(TEXTS)}


def test_against_sql(spark):
    assert rows_of(Q.op3_quality_rules(spark, SMALL)) == duck_rows(quality_rules.oracle_sql())


def test_outliers_go_and_copies_do_not_set_the_norm(spark):
    rnd = np.random.default_rng(3)
    word = lambda: "".join(rnd.choice(list("etaoinshr"), rnd.integers(3, 8)))
    plain = [" ".join(word() for _ in range(rnd.integers(60, 200))) for _ in range(120)]
    odd = [" ".join(word() + "###" for _ in range(100)) for _ in range(12)]
    rows = [(i, t, "en", "s") for i, t in enumerate(plain + odd + odd[:1] * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.judge(df).filter("kept").collect()}
    assert kept == set(range(120))
    assert {r.doc_id for r in quality_rules.keep(df.withColumn("extra", F.lit(1))).collect()} == kept
    few = quality_rules.judge(df.limit(30))
    assert few.filter("kept").count() == 30  # too few to judge by
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_no_python_in_the_rules(spark):
    plan = quality_rules.judge(read_table(spark, SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def plain_mcd(stats):
    """Who is kept, by the definition, with numpy: rows (lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    import hashlib

    R = quality_rules
    vector = lambda r: (np.log(r[3] / r[2]) - 1.6, np.sqrt(r[4] / r[3]), np.sqrt(r[5] / r[2]), np.sqrt(r[6] / r[2]))
    good = [r for r in stats if not r[7]]
    own: dict = {}
    for r in set(r[:7] for r in good):
        own.setdefault(r[:2], []).append(r)
    pool: dict = {}
    for (lang, _), rows in own.items():
        if len(rows) < R.MIN_STRATUM:
            pool[lang] = pool.get(lang, 0) + len(rows)
    name = {k: f"s{len(k[0])}:{k[0]}{k[1]}" if len(v) >= R.MIN_STRATUM else f"l{k[0]}" if pool[k[0]] >= R.MIN_STRATUM else "*" for k, v in own.items()}
    strata: dict = {}
    for k, rows in own.items():
        strata.setdefault(name[k], []).extend(rows)

    def fit(x):
        cov = np.cov(x.T, bias=True).reshape(4, 4) * R.CONSISTENCY + np.diag([f * f for f in R.FLOORS])
        return x.mean(0), cov

    def d2(x, mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def concentrate(x, mean, cov):
        bins = np.floor(R.BINS * np.log(d2(x, mean, cov) + 1e-9))
        nearer = np.array([(bins < b).sum() for b in bins])
        return fit(x[2 * nearer < len(x)])

    fits = {}
    for key, rows in strata.items():
        if key == "*" and len(rows) < R.MIN_STRATUM:
            continue
        x = np.array([vector(r) for r in rows])
        u = np.array([int(hashlib.md5("|".join([key, *map(str, r[2:7])]).encode()).hexdigest()[:8], 16) / 2**32 for r in rows])
        starts, width = [x], 1 / R.STARTS
        for k in range(R.STARTS):
            chosen = (u >= k * width) & (u < k * width + min(width, R.ELEMENTS / len(x)))
            starts += [x[chosen]] if chosen.any() else []
        found = [fit(s) for s in starts]
        for _ in range(R.FIRST_STEPS):
            found = [concentrate(x, *f) for f in found]
        best = min(found, key=lambda f: round(np.linalg.slogdet(f[1])[1] / 2, 9))
        for _ in range(R.LAST_STEPS):
            best = concentrate(x, *best)
        fits[key] = best
    out = []
    for r in stats:
        f = None if r[7] else fits.get(name[r[:2]])
        out.append(False if r[7] else True if f is None else bool(d2(np.array([vector(r)]), *f)[0] <= R.CUTOFF))
    return out


def test_against_plain_mcd(spark):
    """The estimates and verdicts against numpy on the supplied documents, and on strata of their own, pooled by language and over all."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    few = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("r"), (F.col("doc_id") % 90).cast("string"))).otherwise(F.col("source")))
    few = few.withColumn("lang", F.when(F.col("doc_id") % 50 == 1, F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string"))).otherwise(F.col("lang")))
    for df in (docs, few, docs.unionByName(docs.filter("doc_id % 3 = 0")).limit(400)):
        rows = quality_rules.judge(df).join(df.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct(), "doc_id").collect()
        stats = [(r.lang, r.source, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
        assert [r.kept for r in rows] == plain_mcd(stats)
        assert not all(r.kept or r.base_failed for r in rows)


def test_estimates_are_broadcast(spark, monkeypatch):
    """No vector or text is shuffled by its stratum; of more strata than MOST_STRATA the verdicts are the same."""
    docs = read_table(spark, SMALL, "documents")
    plan = quality_rules.keep(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    want = rows_of(quality_rules.judge(docs))
    monkeypatch.setattr(quality_rules, "MOST_STRATA", 0)
    assert rows_of(quality_rules.judge(docs)) == want


def test_classifier_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = Q.op1_quality_classifier(spark, folder).join(read_table(spark, folder, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.predicted == held.quality).mean()) > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.3), (2, "", 0.1), (3, "Good words here. " * 20000, 1.0), (3, "Good", 1.0), (None, "x", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (99, 1), (None, 1)], "doc_id long, quality int")
    out = knn_quality.score(docs, knn_quality.fit(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    none = knn_quality.score(docs, knn_quality.fit(docs, labels.limit(0)))
    assert [r.score for r in none.collect()] == [0.5] * 5
    assert knn_quality.score(docs.limit(0), knn_quality.fit(docs, labels)).count() == 0


def test_repeated_ids_keep_their_place_only(spark, monkeypatch):
    monkeypatch.setattr(knn_quality, "SAMPLE_PER_LABEL", 3)
    learnt = [r.id for r in spark.range(40).filter(~knn_quality.held_out("id")).limit(6).collect()]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(learnt)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"text {'of words ' * k}") for k, i in enumerate(learnt)], "doc_id long, text string")
    again = spark.createDataFrame([(learnt[0], "b" * k) for k in range(20)] + [(learnt[1], None)], "doc_id long, text string")
    one, many = knn_quality.fit(docs, labels), knn_quality.fit(docs.unionByName(again).unionByName(docs), labels)
    assert list(one.labels) == list(many.labels) == [0, 1] * 3
    turned = knn_quality.fit(docs.unionByName(again.orderBy(F.desc("text"))).repartition(3), labels)
    assert np.allclose(abs(turned.vectors), abs(knn_quality.fit(again.unionByName(docs), labels).vectors), atol=1e-4)


def test_votes_are_exact():
    rnd = np.random.default_rng(0)
    counts = rnd.integers(0, 3, (40, knn_quality.TERMS)).astype(np.float32)
    form, words = (rnd.standard_normal((n, 8)).astype(np.float32) for n in (knn_quality.FORM_TERMS, knn_quality.WORD_TERMS))
    ones = np.ones(knn_quality.TERMS, np.float32)
    model = knn_quality.Model(ones, form, words, 0.3, np.zeros((0, 16), np.float32), np.zeros(0))
    vectors, labels = model.project(counts[:30]), rnd.integers(0, 2, 30).astype(float)
    model = knn_quality.Model(ones, form, words, 0.3, vectors, labels)
    got = model.score(counts[30:])
    for x, g in zip(model.project(counts[30:]), got, strict=True):
        cos = vectors @ x
        near = np.argsort(-cos)[: knn_quality.NEIGHBOURS]
        w = np.maximum(cos[near], 1e-9)
        assert g == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-5)


def test_a_label_of_words_is_learnt(spark):
    """Texts of one shape, whose label hangs on which words they use most."""
    rnd = np.random.default_rng(4)
    vocabulary = ["".join(rnd.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(2000):
        y = int(rnd.integers(0, 2))
        own = rnd.random(60) < 0.7
        half = rnd.integers(0, 200, 60) + 200 * np.where(own, y, 1 - y)
        rows.append((i, " ".join(vocabulary[k] for k in half)))
        labels.append((i, y))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = knn_quality.fit(docs, known)
    got = knn_quality.score(docs, model).filter(knn_quality.held_out()).join(known, "doc_id").toPandas()
    assert model.share > 0 and (got.predicted == got.quality).mean() >= 0.95


def test_share_is_learnt():
    rnd = np.random.default_rng(2)
    labels = (np.arange(200) % 2).astype(float)
    told, noise = (np.where(labels[:, None] > 0, 1.0, -1.0) * np.ones(4) if k else rnd.standard_normal((200, 4)) for k in (1, 0))
    told, noise = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (told, noise))
    assert 0 == knn_quality._share(told, noise, labels) < knn_quality._share(noise, told, labels)
