"""Exact top-k, chat formatting, licence scans and SentencePiece against plain versions."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from pyspark.sql import functions as F

from sparkloom.llm import chat_format as C
from sparkloom.llm import exact_topk as K
from sparkloom.llm import license_scan as L
from sparkloom.llm import queries as Q
from sparkloom.llm import sentencepiece_tokenizers as S
from tests.compare import SMALL, duck_rows, rows_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_registered_queries_against_sql(spark):
    for name in ("op4_chat_format", "op7_license_scan", "op9_exact_topk"):
        assert rows_of(Q.QUERIES[name].run(spark, SMALL)) == duck_rows(Q.QUERIES[name].sql), name


def by_row(rows, k, every=10):
    """Each query row's best others, of rows (id, vector) with whole components."""
    want = []
    for a, (q, x) in enumerate(rows):
        if q % every == 0:
            best = sorted((-int(np.dot(x, y)), i) for b, (i, y) in enumerate(rows) if a != b and len(x) == len(y))[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(want)


def test_topk_edges(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 4)], 1) for i in range(60)]
    rows += [(60, None, 1), (61, [1.0, None, 0.0, 0.0], 1), (62, [float("nan"), 0.0, 0.0, 0.0], 1), (63, [float("inf"), 0.0, 0.0, 0.0], 1), (None, [1.0] * 4, 1), (64, [], 1)]
    more = [(5, [3.0] * 4, 2), rows[10], rows[10], rows[10], (20, [1.0, -2.0, 0.5, 0.0], 2), (0, [0.0] * 4, 2), (0, [0.0] * 4, 3), rows[7]]
    more += [(70 + i, [float(x) for x in rnd.integers(-3, 4, 6)], 1) for i in range(13)] + [(80, [1.0], 1)]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>, score int")
    v = K.quantised(df)
    good = [(i, [int(np.floor(256 * x)) for x in e]) for i, e, _ in rows[:60] + more]
    for k in (1, 3):
        got = sorted(tuple(r) for r in K.top_k(v, v.filter("id % 10 = 0"), k).collect())
        assert got == by_row(good, k), k
    few = v.filter("id < 3 and id > 0")
    assert K.top_k(few, few, 5).count() == 2
    assert K.top_k(few.limit(0), few, 5).count() == 0 and K.top_k(few, few.limit(0), 5).count() == 0


def test_topk_in_many_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    rows = [(int(rnd.integers(0, 200)), [int(x) for x in rnd.integers(-9, 10, 5)]) for _ in range(700)] + [(50, [7, 7, 7, 7, 7])] * 60
    v = spark.createDataFrame(rows, "id long, x array<long>").repartition(3)
    monkeypatch.setattr(K, "CANDIDATES", 37)
    monkeypatch.setattr(K, "QUERIES", 5)
    assert sorted(tuple(r) for r in K.top_k(v, v.filter("id % 10 = 0"), 4).collect()) == by_row(rows, 4)


def test_blocks_are_sent_in_the_narrowest_numbers(spark):
    """What is sent is 2 bytes a component for the supplied kind of vectors; wider numbers stay exact."""
    rnd = np.random.default_rng(8)
    for most, width in ((1 << 15, 2), (1 << 15 | 1, 4), (1 << 31, 4), (1 << 31 | 1, 8)):
        rows = [(i, [int(x) for x in rnd.integers(-9, 10, 3)]) for i in range(40)] + [(40, [-most, 0, 1]), (50, [1, most - 1, 1])]
        v = spark.createDataFrame(rows, "id long, x array<long>").coalesce(1)
        (block,) = K._packed(v, 64, "c").collect()
        assert len(block.c_x) == width * 3 * len(rows) and (np.frombuffer(block.c_x, f"<i{width}").reshape(-1, 3) == [x for _, x in rows]).all()
        assert sorted(tuple(r) for r in K.top_k(v, v.filter("id % 10 = 0 and id < 40"), 3).collect()) == [r for r in by_row(rows, 3) if r[0] < 40]


def test_bounds_hold_and_reading_stops():
    rnd = np.random.default_rng(6)
    x, q = rnd.integers(-200, 200, (300, 16)), rnd.integers(-200, 200, (9, 16)).astype(float)
    lists, exact = K.Lists(x), q @ x.T
    upper = [lists.bounds(depth, q) for depth in range(len(K.SLICES))]
    assert all((exact <= u).all() for u in upper) and all((b <= a).all() for a, b in zip(upper, upper[1:], strict=False))
    assert (upper[-1] == exact).all()
    # a bar that no candidate reaches ends the reading at once; without any the block's own leaders make one
    for bar, most in ((exact.max() * 20, K.SLICES[0]), (np.sort(exact, axis=1)[:, -1], 1.0), (np.full(9, -np.inf), 1.0)):
        a, c, score, read = K.block_top(lists, q, 6, np.broadcast_to(bar, 9))
        assert (score == exact[a, c]).all() and read.max() <= most * x.size + (len(K.SLICES) * K.LEADERS * 6 + K.FEW * 300) * 16
        best = np.sort(exact, axis=1)[:, -6:] if np.isneginf(bar).all() else np.zeros((9, 0))
        for k in range(9):
            assert set(best[k]) <= set(score[a == k])


def test_share_of_entries_read():
    """On the supplied vectors, in the module's blocks: scores are those of brute force, and a part of the entries is never read."""
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.floor(256 * np.array(t.column("embedding").to_pylist(), float)).astype(np.int64)
    q = x[t.column("vec_id").to_numpy() % 50 == 0]
    best, shares = K.Best(len(q), 6), []
    for i in range(0, len(x), K.CANDIDATES):
        lists = K.Lists(x[i : i + K.CANDIDATES])
        a, c, score, read = K.block_top(lists, q, 6, best.score[:, -1])
        best.add(a, i + c, score)
        shares.append(read.mean() / lists.x.size)
    assert (best.score == -np.sort(-(q @ x.T), axis=1)[:, :6]).all()
    assert max(shares) < 0.88, shares


def test_grammar_round_trips():
    rnd = random.Random(5)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "[OUT] ", "\\", "<", "[", "/", "a", " ", "]", "[ROLE=", "[/ROLE]", "</", "s>", "é"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        role = rnd.choice(["user", "assistant", "system", "tool", "", " x]"])
        assert [(t.role, t.text) for t in C.parse(C.render([(role, text), ("assistant", text)]))] == [(role, text), ("assistant", text)]
    for bad in ("", "<s>", "<s>[INST] x", "<s>[INST] x [/OUT]</s>", "<s></s>x", "<s>hello</s>"):
        try:
            C.parse(bad)
        except C.GrammarError:
            continue
        raise AssertionError(bad)


def test_conversations(spark):
    rows = [(1, 1, "assistant", None, 5), (1, 0, "user", "hi", 5), (None, 0, None, "x", 5), (2, None, "tool", "[/INST]", 5), (2, 0, "assistant", "a\\b", 5), (2, 0, "assistant", "a\\b", 5)]
    rows += [(3, i, ("user", "assistant")[i % 2], f"turn {i} <s> " * 5, 5) for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    parts = C.formatted(df, part_chars=300)
    assert parts.filter("conv_id = 3").count() > 50
    got = {r.conv_id: r for r in C.read_back(parts).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv), key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in own).encode()).hexdigest()
    assert C.digests(df.limit(0)).count() == 0


def test_licences(spark):
    apache = "Licensed under the Apache License,\nVersion 2.0 (the \"License\"); you may not use this file except in compliance with the License. Text between."
    texts = [None, "", "no word of it", apache, "x Licensed under CC BY-NC 4.0.", "A line.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License. Released under the MIT license.\nAll rights reserved.", "word " * 50_000 + ". All rights reserved."]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = {r.doc_id: (r.licenses, r.license_class, r.n_sentences) for r in L.scan(df).collect()}
    assert got == {
        0: ("", "", 0), 1: ("", "", 0), 2: ("", "", 0), 3: ("Apache-2.0", "permissive", 2), 4: ("", "", 0),
        5: ("MIT,CC-BY-NC-4.0,LicenseRef-all-rights-reserved", "reserved", 4), 6: ("LicenseRef-all-rights-reserved", "reserved", 1),
    }
    assert all(any(h in s for h in L.HINTS) for s in L.SENTENCES)
    assert {i for sequence, _, _ in L.RULES for i in sequence} == set(L.SENTENCES.values()) and {k for *_, k in L.RULES} == set(L.CLASSES)
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert L.scan(df.limit(0)).count() == 0


# The official texts of the rules with several sentences, without titles and lists between.
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.
"""
#: A text, the licence, its class, and the number of known sentences.
OFFICIAL = ((APACHE, "Apache-2.0", "permissive", 4), (MIT, "MIT", "permissive", 2), (GPL, "GPL-3.0-or-later", "copyleft", 2), (BSD, "BSD-3-Clause", "permissive", 3))


def licences_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.licenses, r.license_class, r.n_sentences) for r in L.scan(df).orderBy("doc_id").collect()]


def unwrapped(text):
    return "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))


def test_official_licence_texts_of_unbroken_lines(spark):
    assert licences_of(spark, [unwrapped(t) for t, *_ in OFFICIAL]) == [tuple(want) for _, *want in OFFICIAL]


def test_official_licence_texts_wrapped_and_in_comments(spark):
    signs = ("", "# ", "// ", " * ", "-- ", ";; ", "% ", "! ", "REM ", "dnl ", "| ")
    texts = ["".join(f"{sign}{line}\n" for line in t.split("\n")) for t, *_ in OFFICIAL for sign in signs]
    texts += [f"/*\n{t.replace(chr(10), chr(13) + chr(10))}*/" for t, *_ in OFFICIAL]
    want = [tuple(w) for _, *w in OFFICIAL for _ in signs] + [tuple(w) for _, *w in OFFICIAL]
    assert licences_of(spark, texts) == want


def test_sentences_over_line_ends(spark):
    got = licences_of(spark, [
        "Released under the\nMIT License.", "This work is licensed under the GNU\nGeneral Public License, version 3.", "It is not\nReleased under the\nMIT License",
        "released under the.\nMIT License", "not released under the\nMIT License", "-\n" * 100_000 + "Released under the" + "\n-" * 100_000 + "\nMIT License",
    ])
    mit = ("MIT", "permissive", 1)
    assert got == [mit, ("GPL-3.0-only", "copyleft", 1), mit, ("", "", 0), ("", "", 0), mit]


def test_every_sentence_with_random_space(spark):
    """Each known sentence, with other white space, marks and capitals between its words, gives its own identifier's rule in Spark; within a line in SQL, too."""
    rnd = random.Random(7)
    between = (" ", "  ", "\t", " \n", "\u00a0", "-", ", ", " (", ") ", '" ', "\r\n")
    say = lambda w, gaps: "".join(x + rnd.choice(gaps) for x in w[:-1]) + w[-1]
    sentences = [s.replace("*", "Acme Widgets of Überlingen, Inc.") for s in L.SENTENCES]
    single = {sequence[0]: name for sequence, name, _ in reversed(L.RULES) if len(sequence) == 1}
    want = [single.get(i, "") for i in L.SENTENCES.values()]
    texts = [f"Some words. {say(s.split(), between).capitalize()}. More words." for s in sentences]
    got = licences_of(spark, texts)
    assert [(a, n) for a, _, n in got] == [(w, 1) for w in want]
    plain = [f"Some words. {say(s.split(), [g for g in between if chr(10) not in g])}. More words." for s in sentences]
    table = pa.table({"doc_id": range(len(plain)), "text": plain})
    spark_rows = L.scan(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string"))
    assert rows_of(spark_rows) == duck_rows(L.oracle_sql(), documents=table)


def test_sequences_take_their_sentences(spark):
    """Every rule's sentences in a row give that rule's licence alone."""
    text_of = {i: s.replace("*", "Some Holder") for s, i in reversed(L.SENTENCES.items())}
    texts = [". ".join(text_of[i].capitalize() for i in sequence) + "." for sequence, _, _ in L.RULES]
    got = licences_of(spark, texts)
    assert [(a, k, n) for a, k, n in got] == [(name, kind, len(sequence)) for sequence, name, kind in L.RULES]


def test_hints_of_unusual_white_space(spark):
    texts = [f"All{a}rights{b}reserved." for a in (" ", "\n", "\t", "\u00a0", ", ") for b in ("  ", "\n", "\t", "\u00a0", "\n# ", "-")]
    assert licences_of(spark, texts) == [("LicenseRef-all-rights-reserved", "reserved", 1)] * len(texts)
    assert all(h.isalpha() for h in L.HINTS)


def test_ends_inside_known_sentences(spark):
    later, none = GPL.split("\n\n")
    got = licences_of(spark, [unwrapped(later), unwrapped(none), unwrapped(later).replace("software: you", "software. You"), "Released: under; the MIT License. Text", "xS all rights reserved. H All rights reserved"])
    assert got == [("GPL-3.0-or-later", "copyleft", 1), ("", "", 1), ("", "", 0), ("MIT", "permissive", 1), ("", "", 0)]


#: BSD-3-Clause as it stands in most files, with its holder's name.
BSD_HELD = (BSD.replace("the copyright holder", "Acme Inc.") + "\n").replace("3. Neither", "2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation and/or\nother materials provided with the distribution.\n\n3. Neither")
GPL_2 = GPL.replace("software: you", "software; you").replace("version 3", "version 2")
TAGS = {
    "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;": ("MIT,Apache-2.0", "permissive", 2),
    "SPDX-License-Identifier: GPL-2.0+": ("GPL-2.0-or-later", "copyleft", 1),
    "/* spdx-license-identifier: GPL-2.0-only WITH Linux-syscall-note */": ("GPL-2.0-only", "copyleft", 1),
    "SPDX-License-Identifier: (MIT and Zlib) OR (gpl-2.0 WITH Classpath-exception-2.0 AND CC-BY-4.0).": ("MIT,Zlib,GPL-2.0-only,CC-BY-4.0", "copyleft", 4),
    "SPDX-License-Identifier: Apache-2.0+ AND LicenseRef-own": ("Apache-2.0", "permissive", 1),
    "SPDX-License-Identifier:MIT or not": ("MIT", "permissive", 1),
    "SPDX-License-Identifier: ORACLE": ("", "", 0),
    "SPDX-License-Identifier:\nMIT": ("", "", 0),
    "Licensed under the Apache License 2.0.": ("Apache-2.0", "permissive", 1),
    "Released under MIT License.": ("MIT", "permissive", 1),
}


def test_holders_tags_and_their_sql(spark):
    texts = {
        BSD_HELD: ("BSD-3-Clause", "permissive", 4),
        BSD_HELD.replace("Acme Inc.", "the University of California, Berkeley"): ("BSD-3-Clause", "permissive", 4),
        BSD_HELD.replace("Acme Inc.", "word " * 30): ("BSD-2-Clause", "permissive", 3),
        GPL_2: ("GPL-2.0-or-later", "copyleft", 2),
        "".join(f"# {line}\n" for line in APACHE.split("\n")): ("Apache-2.0", "permissive", 4),
        **{t: (name, kind, n) for t, name, kind, n in OFFICIAL},
        **TAGS,
        MIT + "SPDX-License-Identifier: ISC\n" + BSD_HELD: ("MIT,BSD-3-Clause,ISC", "permissive", 7),
    }
    got = licences_of(spark, list(texts))
    for text, one in zip(texts, got, strict=True):
        assert one == texts[text], text
    table = pa.table({"doc_id": range(len(texts)), "text": list(texts)})
    assert rows_of(L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))) == duck_rows(L.oracle_sql(), documents=table)


def test_pieces(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(3)
    parts = ["a", " ", "  ", "\n", "the", "Über", "日本", "🙂", "\t", "▁", "<s>", "1", "…", " word", " ", "<0x41>"]
    texts = [None, "", " ", "   ", "a" * 5000, *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(3000))]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, parity string")
    rows = S.decode(S.encode(df, MODEL), MODEL).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        want = lib.encode(t or "")
        assert list(np.frombuffer(r.ids, "<u4")) == want and r.n_tokens == len(want), repr(t)
        if r.round_trip and "▁" not in (t or ""):
            assert r.decoded == (t or "")
    assert S.encode(df.limit(0), MODEL).count() == 0


def test_pieces_of_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = Q.op6_sentencepiece(spark, SMALL).collect()
    assert all(r.parity and r.round_trip for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(lib.encode(docs[r.doc_id]), "<u4").tobytes()) for r in rows)


def test_unigram_models_are_rebuilt():
    model = S.Model(pieces=[("<unk>", 0.0, S.UNKNOWN), ("▁", -3.0, S.NORMAL), ("▁ab", -1.0, S.NORMAL), ("a", -4.0, S.NORMAL), ("b", -4.5, S.NORMAL), ("▁a", -2.0, S.NORMAL), ("bb", -2.5, S.NORMAL)], kind=S.UNIGRAM)
    tok = S.build(model)
    assert tok.encode("ab  abb").ids == [2, 5, 6] and tok.decode([2, 5, 6]) == "ab abb"


def field(number, value):
    """A protobuf field: a number, or bytes."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def piece(text, score, kind):
    return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + field(3, kind))


def unigram(model):
    """The model's pieces with scores as of logarithms of frequencies, no two sums alike, in a file of the unigram kind."""
    rnd = random.Random(5)
    made = b"".join(piece(p, s if k != S.NORMAL else -3 - np.log1p(i) - rnd.random() / 2, k) for i, (p, s, k) in enumerate(model.pieces))
    return made + field(2, field(3, 1) + field(35, 1)) + field(3, field(4, 0))


#: Fields appended to a file: protobuf takes later ones for the same message.
OTHERS = {
    "unigram": b"",
    "unigram-user": piece("<turn>", 0.0, 4) + piece("b. c", 0.0, 4),
    "user": piece("<turn>", 0.0, 4) + piece("[x]", 0.0, 4) + piece("zq", 0.0, 4),
    "spanning": piece("of▁the", -5.0, 1),
    "squeezing": field(3, field(4, 1)),
}


def test_other_models(spark, tmp_path):
    """Models of real size: of the unigram kind, with user-defined pieces, with pieces across words, and that drop spaces."""
    rnd = random.Random(11)
    parts = ["of the", "<turn>", "[x]", "zq", "b. c", " word", "Straße", " ", "the", ".", "é", "日本", "x", "\n", "end."]
    texts = [None, "", " a", *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(600))]
    with open(MODEL, "rb") as f:
        own = f.read()
    agree = {}
    for name, more in OTHERS.items():
        path = str(tmp_path / f"{name}.model")
        with open(path, "wb") as f:
            f.write((unigram(S.parse(own)) if name.startswith("unigram") else own) + more)
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = S.encode(df, path).orderBy("doc_id").collect()
        assert [list(np.frombuffer(r.ids, "<u4")) for r in rows] == [lib.encode(t or "") for t in texts], name
        agree[name] = sum(r.parity for r in rows) / len(rows)
    assert min(agree.values()) > 0.5 and agree["squeezing"] > 0.8 and min(agree[k] for k in ("unigram", "user", "spanning")) > 0.99, agree


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert [len(s) for s in P.STAGES] == [2] * 4 and P.ORACLE_SQL is None
    now = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, SMALL).cache()
        assert out.columns == docs.columns and 0 < out.count() <= now.count(), name
        now = out
    kept = now.join(labels, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.quality for r in kept} == {1}
    placed = P.STAGES[-1][1](spark, now, SMALL)
    assert placed.select("doc_id").distinct().count() == now.count()


def test_pipeline_edges(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (1, "word " * 20_000, None, "s", 1), (1, docs.first().text, "en", None, 1)], docs.schema)
    extra = {c: F.lit(i) for i, c in enumerate(("score", "predicted", "_row", "_doc", "_i", "node", "kept", "row_key"))}
    now = docs.unionByName(docs.limit(5)).unionByName(odd).withColumns(extra)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, SMALL).cache()
        assert out.columns == now.columns and out.count() > 10, name
        assert out.exceptAll(now).isEmpty() and out.select(*extra).distinct().count() == 1, name
        assert stage(spark, now.limit(0), SMALL).count() == 0, name
        now = out
    assert P.STAGES[-1][1](spark, now, SMALL).count() >= now.count()
    assert P.STAGES[-1][1](spark, odd, SMALL).filter("length >= 1").count() >= 4
    assert P.STAGES[-1][1](spark, now.limit(0), SMALL).count() == 0
