"""Fill-in-the-middle against lists of lines; rank and select against plain sums."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sparkloom.llm import fill_middle, queries
from sparkloom.llm.bitvector import Bits
from tests.compare import SMALL, duck_rows, rows_of


@given(st.lists(st.booleans(), max_size=2000))
@settings(deadline=None, max_examples=60)
def test_rank_select(flags):
    flags = np.array(flags, bool)
    bits = Bits.of_flags(flags)
    places = np.flatnonzero(flags)
    assert bits.count == len(places)
    assert bits.places().tolist() == places.tolist()
    assert bits.rank(np.arange(len(flags) + 1)[: len(flags)]).tolist() == [int(flags[:i].sum()) for i in range(len(flags))]
    assert len(places) == 0 or bits.select(np.arange(len(places))).tolist() == places.tolist()


@pytest.mark.parametrize("share", [0.001, 0.5, 1.0])
def test_rank_select_large(share):
    flags = np.random.default_rng(1).random(70_001) < share
    bits = Bits.of_flags(flags)
    assert bits.rank(np.array([0, 70_001])).tolist() == [0, flags.sum()]
    assert (bits.select(np.arange(bits.count)) == np.flatnonzero(flags)).all()
    other = Bits.of_places(np.arange(0, 70_001, 3), 70_001)
    assert (bits & other).places().tolist() == [i for i in np.flatnonzero(flags) if i % 3 == 0]
    assert (bits | other).count == len(set(np.flatnonzero(flags)) | set(range(0, 70_001, 3)))


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


HARD = [
    None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "é\nß\n漢字\n😀\n", "a<P>b\nc", "<S>", "x\n<M>", "<\nP>\n<S\n>M>\n<<S\n", "a\r\nb c\n", "\x00\n\x00", "l\n" * 5000,
    "ab\n" * 40_000 + "tail", "<P\n<S\n<M\n",
]


def test_against_lists_of_lines(spark):
    texts = [t for t in HARD for _ in range(8)]
    rows = [(i if i % 9 else None, t, "extra", -1) for i, t in enumerate(texts)] + [(3, "a\nb\nc", "x", 0)] * 3
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("form", T.StringType()), T.StructField("_h1", T.LongType())])
    df = spark.createDataFrame(rows, schema)
    got = fill_middle.transform(df).withColumn("back", fill_middle.restored()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates_and_empty_table(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    assert {r.form for r in fill_middle.transform(df, rate=0).collect()} == {"plain"}
    some = [r.form for r in fill_middle.transform(df, rate=50, spm_rate=0).collect()]
    assert set(some) == {"plain", "psm"} and 120 < some.count("plain") < 280
    assert fill_middle.digests(df.limit(0)).collect() == []


def test_query_against_sql(spark):
    assert rows_of(queries.op12_fill_middle(spark, SMALL)) == duck_rows(fill_middle.oracle_sql())
