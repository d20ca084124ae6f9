"""Licence scans by sentence rules.

Texts are cut in sentences, normalised, and mapped to the identifiers of known
licence sentences; the sequence of identifiers is then matched against ordered
rules, each of which takes what it matches out of the sequence. DataFrame
functions only, by row, no shuffle.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOLDER = 12
_WARRANTY = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_LATER = "{x} is free software you can redistribute it and or modify it under the terms of the gnu {g} public license as published by the free software foundation either version {v} of the license or at your option any later version"
# Known licence sentences, normalised (small letters and digits, single spaces), and their identifiers. A * stands for a holder's name, of at most HOLDER words.
TEXTS = {
    "licensed under the apache license version 2 0 the license": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-as-is",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this program " + _WARRANTY: "gpl-no-warranty",
    "this library " + _WARRANTY: "lgpl-no-warranty",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2": "gpl-2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "gpl-3-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-4-advertising",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-names",
    "neither the name of * nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-names",
    "neither the name of * nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-names",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-names",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-notice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-notice",
    "all rights reserved": "all-reserved",
} | {
    _LATER.format(x=x, g=g, v=v): f"{name}-{v.replace(' ', '.')}-later"
    for x in ("this program", "this library")
    for g, name, versions in (("general", "gpl", ("2", "3")), ("lesser general", "lgpl", ("2 1", "3")), ("affero general", "agpl", ("3",)))
    for v in versions
}
# Names of licences in short notices and tags, the SPDX names, their classes, and the identifiers of such notices.
NAMES = (
    ("mit license", "MIT", "permissive", "mit-notice"),
    ("apache license version 2 0", "Apache-2.0", "permissive", "apache-2-notice"),
    ("isc license", "ISC", "permissive", "isc-notice"),
    ("bsd 2 clause license", "BSD-2-Clause", "permissive", "bsd-2-notice"),
    ("bsd 3 clause license", "BSD-3-Clause", "permissive", "bsd-3-notice"),
    ("bsd 4 clause license", "BSD-4-Clause", "permissive", "bsd-4-notice"),
    ("boost software license version 1 0", "BSL-1.0", "permissive", "bsl-notice"),
    ("zlib license", "Zlib", "permissive", "zlib-notice"),
    ("gnu general public license version 2", "GPL-2.0-only", "copyleft", "gpl-2-notice"),
    ("gnu general public license version 3", "GPL-3.0-only", "copyleft", "gpl-3-notice"),
    ("gnu lesser general public license version 2 1", "LGPL-2.1-only", "copyleft", "lgpl-2.1-notice"),
    ("gnu lesser general public license version 3", "LGPL-3.0-only", "copyleft", "lgpl-3-notice"),
    ("gnu affero general public license version 3", "AGPL-3.0-only", "copyleft", "agpl-3-notice"),
    ("mozilla public license version 2 0", "MPL-2.0", "copyleft", "mpl-2-notice"),
    ("eclipse public license version 2 0", "EPL-2.0", "copyleft", "epl-2-notice"),
    ("unlicense", "Unlicense", "public-domain", "unlicense-notice"),
)
# Other names in short notices.
OTHER_NAMES = (
    ("apache license 2 0", "apache-2-notice"),
    ("apache 2 0 license", "apache-2-notice"),
    ("apache license version 2", "apache-2-notice"),
    ("gnu general public license v2", "gpl-2-notice"),
    ("gnu general public license v3", "gpl-3-notice"),
    ("gnu gpl version 2", "gpl-2-notice"),
    ("gnu gpl version 3", "gpl-3-notice"),
    ("gnu affero general public license v3", "agpl-3-notice"),
    ("gnu lesser general public license v3", "lgpl-3-notice"),
    ("mozilla public license 2 0", "mpl-2-notice"),
    ("eclipse public license 2 0", "epl-2-notice"),
    ("boost software license 1 0", "bsl-notice"),
)
# Kinds of the 4.0 Creative Commons licences: the letters, the full name, the class.
COMMONS = (
    ("by", "attribution", "permissive"),
    ("by sa", "attribution sharealike", "copyleft"),
    ("by nc", "attribution noncommercial", "noncommercial"),
    ("by nd", "attribution noderivatives", "noderivatives"),
    ("by nc sa", "attribution noncommercial sharealike", "noncommercial"),
    ("by nc nd", "attribution noncommercial noderivatives", "noncommercial"),
)
# How a short notice begins.
BEGINNINGS = ("licensed under", "released under", "distributed under", "this work is licensed under", "this project is licensed under", "this software is licensed under", "this content is licensed under", "this text is licensed under")
#: SPDX names of notices that say "or later", by identifier.
LATER = {"gpl-2-later": "GPL-2.0-or-later", "gpl-3-later": "GPL-3.0-or-later", "lgpl-2.1-later": "LGPL-2.1-or-later", "lgpl-3-later": "LGPL-3.0-or-later", "agpl-3-later": "AGPL-3.0-or-later"}


#: All known sentences: the texts, and the short notices that the names make.
SENTENCES = (
    TEXTS
    | {f"{begin} {the}{name}": key for begin in BEGINNINGS for name, key in ((*((n, k) for n, *_, k in NAMES), *OTHER_NAMES)) for the in ("the ", "")}
    | {f"{begin} cc {letters} 4 0": f"cc-{letters.replace(' ', '-')}-4" for begin in BEGINNINGS if "licensed" in begin for letters, _, _ in COMMONS}
    | {f"this work is licensed under a creative commons {name} 4 0 international license": f"cc-{letters.replace(' ', '-')}-4" for letters, name, _ in COMMONS}
)
#: Identifiers of the names in tags, which are compared without regard to case. The last ones are older names; any other name may end in a plus.
TAG_NAMES = (
    {name.lower(): key for _, name, _, key in NAMES}
    | {name.lower(): key for key, name in LATER.items()}
    | {f"cc-{letters.replace(' ', '-')}-4.0": f"cc-{letters.replace(' ', '-')}-4" for letters, _, _ in COMMONS}
    | {"cc0-1.0": "cc0-notice"}
    | {name.lower().removesuffix("-only"): key for _, name, _, key in NAMES}
    | {f"{name.lower().removesuffix('-or-later')}+": key for key, name in LATER.items()}
)
# A tag and its expression: names, each perhaps in brackets, with AND, OR or WITH between; a name; what is added to a name by WITH.
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
_TAG = rf"(?i)SPDX-License-Identifier:[ \t]*([( \t]*{_NAME}(?:[) \t]*[ \t)](?:AND|OR|WITH)[ \t(][( \t]*{_NAME})*)"
_WITH = rf"(?i)[ \t)]WITH[ \t(]+{_NAME}"
# Every known sentence has one of these, each within a word, so a text without any has none.
HINTS = ("licens", "reserved", "permi", "redistribut", "warrant", "acknowledgement", "mozilla", "unencumbered", "neighboring", "gpl")
# Ordered rules: a sequence of identifiers, the licence's SPDX name (LicenseRef- where there is none), and its class.
RULES = (
    (("apache-2-notice", "apache-2-comply", "apache-2-copy", "apache-2-as-is"), "Apache-2.0", "permissive"),
    (("apache-2-notice", "apache-2-comply", "apache-2-as-is"), "Apache-2.0", "permissive"),
    (("apache-2-notice", "apache-2-comply"), "Apache-2.0", "permissive"),
    (("mit-grant", "mit-condition", "mit-as-is"), "MIT", "permissive"),
    (("mit-grant", "mit-condition"), "MIT", "permissive"),
    (("isc-grant", "isc-as-is"), "ISC", "permissive"),
    (("zlib-as-is", "zlib-grant"), "Zlib", "permissive"),
    (("bsl-grant", "mit-as-is"), "BSL-1.0", "permissive"),
    (("unlicense-notice", "mit-as-is"), "Unlicense", "public-domain"),
    *(((key, f"{'lgpl' if key.startswith('lgpl') else 'gpl'}-no-warranty"), name, "copyleft") for key, name in LATER.items()),
    (("gpl-2-only", "gpl-no-warranty"), "GPL-2.0-only", "copyleft"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-4-advertising", "bsd-3-names"), "BSD-4-Clause", "permissive"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-3-names"), "BSD-3-Clause", "permissive"),
    (("bsd-grant", "bsd-source", "bsd-3-names"), "BSD-3-Clause", "permissive"),
    (("bsd-grant", "bsd-3-names"), "BSD-3-Clause", "permissive"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause", "permissive"),
    (("mit-grant",), "MIT", "permissive"),
    (("isc-grant",), "ISC", "permissive"),
    *(((key,), name, kind) for _, name, kind, key in NAMES),
    *(((key,), name, "copyleft") for key, name in LATER.items()),
    (("gpl-2-only",), "GPL-2.0-only", "copyleft"),
    (("bsd-grant",), "BSD-2-Clause", "permissive"),
    (("mpl-2-copy",), "MPL-2.0", "copyleft"),
    (("bsl-grant",), "BSL-1.0", "permissive"),
    (("zlib-grant",), "Zlib", "permissive"),
    (("cc0-notice",), "CC0-1.0", "public-domain"),
    *(((f"cc-{letters.replace(' ', '-')}-4",), f"CC-{letters.replace(' ', '-').upper()}-4.0", kind) for letters, _, kind in reversed(COMMONS)),
    (("all-reserved",), "LicenseRef-all-rights-reserved", "reserved"),
)
#: The class of a text with several licences is the first of these that one of them has.
CLASSES = ("reserved", "noncommercial", "noderivatives", "copyleft", "permissive", "public-domain")
#: Known sentences are looked up in one of so many small maps, chosen by their crc32.
_SHELVES = 64

_BREAK = "\x01"
# A sentence ends at a stop before white space, and at a line end, but after a comma, before a capital, a digit, an empty line or a comment sign.
_STOP, _LINE = r"([.!?;:])[ \t\n\r\f]+", r"([^, \n])[ \t\r\f]*\n[ \t\r\f]*([\p{Lu}\p{N}\n*#/|-])"
# An end that no known sentence has inside it: a stop but ';' and ':'. Comment signs that begin a line, which are no stops.
_HARD, _SIGNS = f"[.!?]{_BREAK}", r"""(?m)^[ \t]*(?:[!%;:"'<>({][!%;:"'<>({*#/|-]*|REM|dnl)(?=[ \t\r\n]|$)"""


def _alternatives(sentences: list[list[str]]) -> str:
    """A pattern of word lists that share their beginnings, longer ones first; words have a space or a soft end between, a holder's name also hard ones."""
    heads: dict[str, list[list[str]]] = {}
    for first, *rest in sentences:
        heads.setdefault(first, []).append(rest)
    out = []
    for word in sorted(heads, key=len, reverse=True):
        more = [r for r in heads[word] if r]
        own, between = (f"[a-z0-9]+(?:[ SH][a-z0-9]+){{0,{HOLDER - 1}}}?", "[ SH]") if word == "*" else (word, "[ S]")
        out.append(own + (f"(?:{between}(?:{_alternatives(more)}))" + "?" * (len(more) < len(heads[word])) if more else ""))
    return "|".join(out)


def _slots() -> list[tuple[str, str]]:
    """Beginning and end of each known sentence with a holder's name."""
    return [tuple(s.split("*")) for s in SENTENCES if "*" in s]


def _known_sentences(text: F.Column) -> F.Column:
    """The known sentences of a text, in order: whole pieces between ends, and pieces joined over soft ends.

    The text becomes its words with one character between: a space, S (a soft end) or H (a hard one).
    """
    text = F.regexp_replace(text, _SIGNS, "#;")
    cut = F.lower(F.regexp_replace(F.regexp_replace(text, _STOP, f"$1{_BREAK}"), _LINE, f"$1{_BREAK}$2"))
    # no capital is left but these marks
    marked = F.concat(F.lit("H"), F.replace(F.regexp_replace(cut, _HARD, "H"), F.lit(_BREAK), F.lit("S")), F.lit("H"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9SH]+", " "), " ?S[ S]*", "S"), "[ S]?H[ SH]*", "H")
    longest = _alternatives([s.split() for s in SENTENCES])

    def known(match: F.Column) -> F.Column:
        words = F.translate(F.substring(match, 2, 1 << 20), "SH", "  ")
        return reduce(lambda w, slot: F.when(F.startswith(w, F.lit(slot[0])) & F.endswith(w, F.lit(slot[1])), F.lit("*".join(slot))).otherwise(w), _slots(), words)

    return F.transform(F.regexp_extract_all(plain, F.lit(f"[HS](?:{longest})(?=[HS])"), F.lit(0)), known)


def _tagged(text: F.Column) -> F.Column:
    """The identifiers of the names in a text's SPDX tags, in order: of all names that AND and OR join, but not of what WITH adds."""
    names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_TAG), F.lit(1)), lambda e: F.regexp_extract_all(F.lower(F.regexp_replace(e, _WITH, " ")), F.lit(_NAME), F.lit(0))))
    known = F.expr("map(" + ", ".join(f"'{n}', '{i}'" for n, i in TAG_NAMES.items()) + ")")
    ids = F.transform(names, lambda n: F.coalesce(F.try_element_at(known, n), F.try_element_at(known, F.regexp_replace(n, "[+]$", ""))))
    return F.filter(ids, lambda i: i.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses, license_class and n_sentences of each row of docs (columns doc_id, text).

    licenses: the SPDX names of the rules that matched, in the order of the rules,
    each once, joined by commas; license_class: the strictest of their classes.
    Both are empty strings where no rule matches; n_sentences counts the known
    sentences, and the known names in SPDX tags. A tag is read as an expression,
    wherever it stands: all names that AND or OR join are found, a plus is "or later",
    what WITH adds is left out, unknown names are no licences. A holder's name may
    stand where a known sentence has a place for it. A known sentence may hold line ends, with or without
    comment signs, and stops at ';' or ':'. A rule matches where its identifiers follow each other with no
    other known sentence between; ordinary text between does not matter, and
    several licences, also repeated ones, are all found. A null text is empty;
    other columns are ignored; repeated rows each give a row; no rows, no result.
    """
    text = F.coalesce("text", F.lit(""))
    hint = reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(h)) for h in HINTS))
    shelves = [[x for s, i in SENTENCES.items() if zlib.crc32(s.encode()) % _SHELVES == k for x in (s, i)] for k in range(_SHELVES)]
    known = F.expr("array(" + ", ".join(f"cast(map({', '.join(map(repr, x))}) as map<string, string>)" for x in shelves) + ")")
    ids = F.transform(_known_sentences(text), lambda s: F.try_element_at(F.get(known, F.pmod(F.crc32(s), F.lit(_SHELVES)).cast("int")), s))
    tags = F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), _tagged(text)).otherwise(F.array().cast("array<string>"))
    ids = F.concat(ids, tags)
    df = docs.select("doc_id", F.explode(F.array(F.when(hint, ids).otherwise(F.array().cast("array<string>")))).alias("_ids"))
    df = df.withColumn("n_sentences", F.size("_ids").cast("long"))
    # each identifier between commas of its own, so that one rule's match does not hide its neighbour
    left = F.concat(F.lit(","), F.array_join("_ids", ",,"), F.lit(","))
    rules = F.expr("array(" + ", ".join(f"named_struct('want', ',{',,'.join(sequence)},', 'name', ',{name}', 'kind', ',{kind}')" for sequence, name, kind in RULES) + ")")

    def match(now: F.Column, rule: F.Column) -> F.Column:
        hit = F.contains(now["left"], rule["want"])
        more = lambda c: F.concat(now[c + "s"], F.when(hit, rule[c]).otherwise(F.lit(""))).alias(c + "s")
        return F.struct(F.replace(now["left"], rule["want"], F.lit("")).alias("left"), more("name"), more("kind"))

    found = F.when(F.size("_ids") > 0, F.aggregate(rules, F.struct(left.alias("left"), F.lit("").alias("names"), F.lit("").alias("kinds")), match))
    df = df.select("doc_id", "n_sentences", F.explode(F.array(found)).alias("_f"))
    names, kinds = (F.array_distinct(F.slice(F.split(F.coalesce(F.col(f"_f.{c}"), F.lit("")), ","), 2, len(RULES))) for c in ("names", "kinds"))
    strict = F.coalesce(*(F.when(F.array_contains(kinds, c), F.lit(c)) for c in CLASSES), F.lit(""))
    return df.select("doc_id", F.array_join(names, ",").alias("licenses"), strict.alias("license_class"), "n_sentences")


def oracle_sql(documents: str = "documents") -> str:
    """DuckDB SQL for scan(): one plain list of all sentences as the pattern, with every end written twice, once for each sentence at it."""
    held = " [a-z0-9]+(?:(?: |SS|HH)[a-z0-9]+){0,%d}?(?: |SS|HH)" % (HOLDER - 1)
    pattern = "|".join((held if "*" in s else "").join(part.strip().replace(" ", "(?: |SS)") for part in s.split("*")) for s in sorted(SENTENCES, key=len, reverse=True))
    table = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    tags = ", ".join(f"('{n}', '{i}')" for n, i in TAG_NAMES.items())
    slot = " ".join(f"WHEN starts_with(w, '{a}') AND ends_with(w, '{b}') THEN '{a}*{b}'" for a, b in _slots())
    signs = _SIGNS.replace("(?=[ \\t\\r\\n]|$)", "([ \\t\\r\\n]|$)").replace("'", "''")
    steps, names, kinds = [], [], []
    for k, (sequence, name, kind) in enumerate(RULES):
        want = "," + ",,".join(sequence) + ","
        steps.append(f"r{k} AS (SELECT *, contains(left{k}, '{want}') AS m{k}, replace(left{k}, '{want}', '') AS left{k + 1} FROM {'l' if not k else f'r{k - 1}'})")
        names.append(f"CASE WHEN m{k} THEN '{name}' END")
        kinds.append((kind, f"m{k}"))
    strict = " ".join(f"WHEN {' OR '.join(m for c, m in kinds if c == want)} THEN '{want}'" for want in CLASSES)
    return rf"""
WITH known(s, id) AS (VALUES {table}), tag(s, id) AS (VALUES {tags}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {documents}),
a AS (SELECT r, lower(regexp_replace(regexp_replace(regexp_replace(text, '{signs}', '#;\1', 'g'), '{_STOP}', '\1' || chr(1), 'g'), '{_LINE}', '\1' || chr(1) || '\2', 'g')) AS x FROM d WHERE regexp_matches(lower(text), '{"|".join(HINTS)}')),
b AS (SELECT r, 'H' || replace(regexp_replace(x, '[.!?]' || chr(1), 'H', 'g'), chr(1), 'S') || 'H' AS x FROM a),
c AS (SELECT r, regexp_replace(regexp_replace(regexp_replace(x, '[^a-z0-9SH]+', ' ', 'g'), ' ?S[ S]*', 'S', 'g'), '[ S]?H[ SH]*', 'H', 'g') AS x FROM b),
e AS (SELECT r, regexp_extract_all(replace(replace(x, 'S', 'SS'), 'H', 'HH'), '[HS](?:{pattern})[HS]') AS p FROM c),
u AS (SELECT r, unnest(range(1, len(p) + 1)) AS i, regexp_replace(substr(unnest(p), 2), '[HS]+$', '') AS x FROM e),
v AS (SELECT r, i, replace(replace(x, 'SS', ' '), 'HH', ' ') AS w FROM u),
w AS (SELECT r, i, CASE {slot} ELSE w END AS w FROM v),
x AS (SELECT r, i, unnest(range(1, len(y) + 1)) AS j, lower(unnest(y)) AS w FROM
    (SELECT r, i, regexp_extract_all(regexp_replace(z, '{_WITH}', ' ', 'g'), '{_NAME}') AS y FROM
        (SELECT r, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS z FROM (SELECT r, regexp_extract_all(text, '{_TAG}', 1) AS p FROM d WHERE regexp_matches(lower(text), '{"|".join(HINTS)}'))))),
y AS (SELECT r, 0 AS k, i, 0 AS j, id FROM w JOIN known ON s = w UNION ALL
    SELECT r, 1, i, j, coalesce(t.id, o.id) FROM x LEFT JOIN tag t ON t.s = w LEFT JOIN tag o ON o.s = regexp_replace(w, '[+]$', '') WHERE coalesce(t.id, o.id) IS NOT NULL),
i AS (SELECT r, string_agg(id, ',,' ORDER BY k, i, j) AS ids, count(*) AS n FROM y GROUP BY r),
l AS (SELECT d.r, doc_id, ',' || coalesce(ids, '') || ',' AS left0, coalesce(n, 0) AS n FROM d LEFT JOIN i ON d.r = i.r),
{", ".join(steps)}
SELECT doc_id, array_to_string(list_filter(list_distinct_kept, lambda x: x IS NOT NULL), ',') AS licenses, CASE {strict} ELSE '' END AS license_class, CAST(n AS BIGINT) AS n_sentences
FROM (SELECT *, list_filter([{", ".join(names)}], lambda x, k: x IS NOT NULL AND list_position([{", ".join(names)}], x) = k) AS list_distinct_kept FROM r{len(RULES) - 1}) f"""
