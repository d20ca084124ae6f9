"""Fill-in-the-middle: cut texts at two of their lines' ends, found by rank and select.

The bytes of a slice of texts have two packed bit vectors, one with a one at each
line's last byte, one at each character's first byte. A text's number of lines n
is a difference of ranks; the byte of a cut is a select; the characters of a part
are a difference of ranks again. No text is split into a list of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.bitvector import Bits
from sparkloom.llm.chunks import slices, string_buffers
from sparkloom.llm.common import settled

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_DRAWS = ("_h1", "_h2", "_h3", "_h4")


def draws(key: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 of each key, from the SHA-256 of seed, colon and the key in decimals (nothing for a null key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def line_ends(offsets: np.ndarray, raw: np.ndarray) -> Bits:
    """Ones at the last byte of each line; a text's end ends a line, too."""
    flags = raw == 10
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    flags[ends] = True
    return Bits.of_flags(flags)


def cuts(offsets: np.ndarray, raw: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text: its lines n, the bytes after prefix and middle, and the characters of both."""
    lines, chars = line_ends(offsets, raw), Bits.of_flags((raw & 0xC0) != 0x80)
    first = lines.rank(offsets[:-1])
    n = lines.rank(offsets[1:]) - first
    a, b = h1 % (n + 1), h2 % (n + 1)

    def byte(units: np.ndarray) -> np.ndarray:
        out = offsets[:-1].copy()
        some = units > 0
        out[some] = lines.select(first[some] + units[some] - 1) + 1
        return out

    one, two = byte(np.minimum(a, b)), byte(np.maximum(a, b))
    head, mid = chars.rank(one), chars.rank(two)
    return n, one, two, head - chars.rank(offsets[:-1]), mid - head


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output to the rows of df, in place of columns of these names.

    A line is a run up to and with a newline, the last one may lack it; n counts
    them. Of the four draws of a row's key two choose the cuts, one whether the row
    is taken (in `rate` of 100), one whether suffix (spm, in `spm_rate` of 100) or
    prefix (psm) comes first. A text that is null or empty, holds a mark, or is not
    taken stays as it is, form plain, without counts of characters (null). Either
    part may be empty. Rows of one key are cut by the same draws; rows and order
    stay, repeated ones included. The draws are made by SQL functions, the cuts in
    Arrow batches: no shuffle, memory bounded by a slice of texts or the longest one.
    """
    added = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    df = df.drop(*(n for n, _ in added))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])
    kept = df.columns
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                offsets, raw = string_buffers(batch.column(text))
                h1, h2, h3, h4 = (batch.column(c).to_numpy(zero_copy_only=False) for c in _DRAWS)
                n, one, two, prefix, middle = cuts(offsets, raw, h1, h2)
                data, at = memoryview(raw), offsets.tolist()
                forms, outputs = [], []
                for i, (lo, x, y, hi) in enumerate(zip(at, one.tolist(), two.tolist(), at[1:], strict=False)):
                    own = bytes(data[lo:hi])
                    form = PLAIN if not own or h3[i] % 100 >= rate or any(m in own for m in marks) else SPM if h4[i] % 100 < spm_rate else PSM
                    forms.append(form)
                    if form != PLAIN:
                        p, m, s = data[lo:x], data[x:y], data[y:hi]
                        own = b"".join((marks[1], s, marks[0], p, marks[2], m) if form == SPM else (marks[0], p, marks[1], s, marks[2], m))
                    outputs.append(own)
                form = pa.array(forms, pa.string())
                plain = np.array([f == PLAIN for f in forms], bool)
                new = [pa.array(n), form, pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], schema.names)

    return df.withColumns(dict(zip(_DRAWS, draws(key, seed), strict=True))).mapInArrow(settled(work), schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from, by its form. A text with marks in it is never cut, so each mark is found where it was put."""
    out = F.col(output)

    def part(after: str, before: str | None) -> Column:
        start = F.locate(after, out) + len(after)
        return F.substring(out, start, (F.locate(before, out) if before else F.char_length(out) + 1) - start)

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    return F.when(F.col(form) == PSM, psm).when(F.col(form) == SPM, spm).otherwise(out)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n, form, counts and digests of every row's output, and of the text rebuilt from it."""
    out = transform(df.select(key, text), key, text)
    return out.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """The same by lists of lines."""
    return r"""
    with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id::varchar) as h from documents),
    u as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as lines,
        ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[25:32])::bigint as h4 from t),
    v as (select *, len(lines) as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
    w as (select *, array_to_string(lines[1:a], '') as p, array_to_string(lines[a + 1:b], '') as m, array_to_string(lines[b + 1:n], '') as s from v)
    select doc_id, n::bigint as n, form,
        case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
        sha256(text) as restored_sha256
    from w"""
