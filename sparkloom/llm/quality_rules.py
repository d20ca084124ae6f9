"""Quality rules: base rules, then robust multivariate outliers by language and source.

DataFrame and SQL functions only. The multivariate rule is the regularised
minimum covariance determinant: for each stratum of rows, the half of the
distinct statistic vectors whose covariance has the least determinant is sought
by concentration steps from several deterministic starts, and rows are rejected
by their Mahalanobis distance from its mean under its covariance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, written

# What a word is, and the symbols that are counted.
SPACES, SYMBOLS, _BLANKS = r"[ \t-\r]+", "#*$%&|<>", " \t\n\x0b\f\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Statistic vectors that a stratum needs for estimates of its own.
MIN_STRATUM = 50
#: Rows are rejected beyond this squared distance: the 0.99995 quantile of chi-squared with 4 degrees.
CUTOFF = 25.0
#: What makes the covariance of a half consistent for a normal law in 4 dimensions.
CONSISTENCY = 2.112
#: Added to each statistic's variance, squared: spreads below these are no reason to reject.
FLOORS = (0.08, 0.03, 0.12, 0.16)
#: Random starts of about ELEMENTS vectors besides the start from all; steps before and after the choice.
STARTS, ELEMENTS, FIRST_STEPS, LAST_STEPS = 4, 12, 2, 4
#: Strata whose estimates are broadcast, at most (some 200 bytes for each start of a stratum); of more, vectors are joined with them by shuffling.
MOST_STRATA = 20_000
#: Distances are ranked in bins, so many for each factor e.
BINS = 16

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_D = range(1, 5)
_PAIRS = [(i, j) for i in _D for j in range(1, i + 1)]
#: The transformed statistics of a row with words.
VECTOR = {
    1: "ln(CAST(word_chars AS DOUBLE) / n_words) - 1.6",
    2: "sqrt(CAST(n_symbols AS DOUBLE) / word_chars)",
    3: "sqrt(CAST(n_dup_lines AS DOUBLE) / n_words)",
    4: "sqrt(CAST(n_repeat_words AS DOUBLE) / n_words)",
}


def _held(df: DataFrame, name: str, value: F.Column) -> DataFrame:
    """Add a column that is computed once: no later expression is merged into it across the generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def text_statistics(docs: DataFrame, *carried: F.Column) -> DataFrame:
    """doc_id, lang, source, the word statistics of each row of docs, base_failed, and the columns `carried`.

    A null text has no words and fails the base rules, as an empty one does. Null
    lang or source count as the empty string. Three-word windows are compared by
    64-bit hashes within a text (two different ones of a text of 20,000 words
    meet with a chance of one in 10^11). Repeated rows each give a row.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("_t"), *carried)
    df = df.withColumn("n_symbols", F.length("_t") - F.length(F.translate("_t", SYMBOLS, "")))
    df = df.withColumn("word_chars", F.length(F.translate("_t", _BLANKS, "")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    df = _held(df, "_l", lines)
    df = df.withColumn("n_dup_lines", F.size("_l") - F.size(F.array_distinct("_l"))).drop("_l")
    # of a text that begins and ends with a word every part of the split is a word
    hashed = F.transform(F.split(F.btrim("_t", F.lit(_BLANKS)), SPACES), lambda x: F.xxhash64(x))
    df = _held(df, "_w", F.when(F.col("word_chars") > 0, hashed).otherwise(F.array().cast("array<bigint>"))).drop("_t")
    df = df.withColumn("n_words", F.size("_w"))
    first = F.slice("_w", 1, F.greatest(F.lit(0), F.size("_w") - 2))
    df = _held(df, "_v", F.transform(first, lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))).drop("_w")
    some = F.size(F.array_distinct("_v")) < F.size("_v")
    df = _held(df, "_s", F.when(some, F.array_sort(F.transform("_v", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("_v")
    twice = F.zip_with(
        F.slice("_s", 1, F.size("_s") - 1),
        F.slice("_s", 2, F.size("_s") - 1),
        lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)).otherwise(F.array().cast("array<int>")),
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("_s").isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(twice))))).drop("_s")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = [c for c in df.columns if c not in ("doc_id", "lang", "source", *_STATS)]
    return df.select("doc_id", "lang", "source", *(F.col(c).cast("long").alias(c) for c in _STATS), *kept).withColumn("base_failed", failed)


# ---- the estimates, as SQL that any engine with window functions runs ----

_MOMENTS = ", ".join([f"sum(v{i}) AS s{i}" for i in _D] + [f"sum(v{i} * v{j}) AS s{i}{j}" for i, j in _PAIRS])


def _strata_sql(stats: str) -> str:
    """The stratum of each (lang, source): itself, its language's small sources together, or all that is left; n: its vectors."""
    return f"""
WITH sized AS (SELECT lang, source, count(*) AS k FROM (SELECT DISTINCT lang, source, {", ".join(_STATS)} FROM {stats} WHERE NOT base_failed) d GROUP BY lang, source),
pooled AS (SELECT lang, sum(k) AS k FROM sized WHERE k < {MIN_STRATUM} GROUP BY lang),
named AS (SELECT s.lang, s.source, s.k,
  CASE WHEN s.k >= {MIN_STRATUM} THEN concat('s', CAST(length(s.lang) AS VARCHAR(20)), ':', s.lang, s.source) WHEN p.k >= {MIN_STRATUM} THEN concat('l', s.lang) ELSE '*' END AS stratum
  FROM sized s LEFT JOIN pooled p ON s.lang = p.lang)
SELECT lang, source, stratum, sum(k) OVER (PARTITION BY stratum) AS n FROM named"""


def _vectors_sql(stats: str, strata: str, hexed: str) -> str:
    """The distinct vectors of each language and source with their stratum, its size n, and a number u from 0 to 1 by hash. Copies have one vote."""
    frac = hexed.format(x="md5(concat(stratum, '|', " + ", '|', ".join(f"CAST({c} AS VARCHAR(20))" for c in _STATS) + "))")
    return f"""
SELECT stratum, n, {", ".join(f"{e} AS v{i}" for i, e in VECTOR.items())}, {frac} AS u
FROM (SELECT DISTINCT s.lang, s.source, t.stratum, t.n, {", ".join("s." + c for c in _STATS)} FROM {stats} s JOIN {strata} t ON s.lang = t.lang AND s.source = t.source
  WHERE NOT s.base_failed AND (t.n >= {MIN_STRATUM} OR t.stratum <> '*')) d"""


def _fit_sql(sums: str) -> str:
    """From sums (stratum, start, n, s1.., s11..): means m, Cholesky factor l of the regularised covariance, log determinant."""
    cov = {(i, j): f"greatest(s{i}{j} / n - (s{i} / n) * (s{j} / n), 0.0)" if i == j else f"s{i}{j} / n - (s{i} / n) * (s{j} / n)" for i, j in _PAIRS}
    sql = "SELECT stratum, start, " + ", ".join(f"s{i} / n AS m{i}" for i in _D) + ", "
    sql += ", ".join(f"{CONSISTENCY} * ({e})" + (f" + {FLOORS[i - 1] ** 2:.6f}" if i == j else "") + f" AS c{i}{j}" for (i, j), e in cov.items()) + f" FROM {sums}"
    have = ["stratum", "start", *(f"m{i}" for i in _D)]
    for j in _D:  # one column of the factor at a time
        less = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
        keep = have + [f"l{a}{b}" for a, b in _PAIRS if b < j] + [f"c{a}{b}" for a, b in _PAIRS if b >= j and (a, b) != (j, j)]
        sql = f"SELECT {', '.join(keep)}, sqrt(greatest(c{j}{j}{less}, 1e-9)) AS l{j}{j} FROM ({sql}) a{j}"
        keep = have + [f"l{a}{b}" for a, b in _PAIRS if b < j or (a, b) == (j, j)] + [f"c{a}{b}" for a, b in _PAIRS if b > j]
        below = [f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, 5)]
        sql = f"SELECT {', '.join(keep + below)} FROM ({sql}) b{j}"
    det = " + ".join(f"ln(l{i}{i})" for i in _D)
    return f"SELECT {', '.join(have + [f'l{a}{b}' for a, b in _PAIRS])}, {det} AS det FROM ({sql}) f"


def _distance_sql(rows: str, columns: str) -> str:
    """columns and d2 of rows that hold v, m and l: forward substitution, one unknown at a time."""
    sql = rows
    for i in _D:
        z = f"(v{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(1, i)) + f") / l{i}{i}"
        sql = f"SELECT *, {z} AS z{i} FROM ({sql}) z{i}_"
    return f"SELECT {columns}, {' + '.join(f'z{i} * z{i}' for i in _D)} AS d2 FROM ({sql}) d_"


def _start_sql(vectors: str) -> str:
    """The first estimates: from all vectors (start 0) and from about ELEMENTS of them by hash (starts 1 and up)."""
    one = f"SELECT stratum, 0 AS start, CAST(count(*) AS DOUBLE) AS n, {_MOMENTS} FROM {vectors} GROUP BY stratum"
    width = 1.0 / STARTS
    few = [
        f"SELECT stratum, {k} AS start, CAST(count(*) AS DOUBLE) AS n, {_MOMENTS} FROM {vectors} WHERE u >= {(k - 1) * width} AND u < {(k - 1) * width} + least({width}, {ELEMENTS}.0 / n) GROUP BY stratum"
        for k in range(1, STARTS + 1)
    ]
    return _fit_sql("(" + " UNION ALL ".join([one, *few]) + ") s_")


def _step_sql(vectors: str, fits: str) -> str:
    """A concentration step: refit to the half of a stratum's vectors that is nearest, in whole distance bins."""
    m = ", ".join([f"p.m{i}" for i in _D] + [f"p.l{i}{j}" for i, j in _PAIRS])
    rows = f"SELECT v.stratum, p.start, v.n, {', '.join(f'v.v{i}' for i in _D)}, {m} FROM {vectors} v JOIN {fits} p ON v.stratum = p.stratum"
    near = _distance_sql(rows, "stratum, start, n, " + ", ".join(f"v{i}" for i in _D))
    binned = f"SELECT stratum, start, CAST(floor({BINS} * ln(d2 + 1e-9)) AS INT) AS bin, max(n) AS n, count(*) AS k, {_MOMENTS} FROM ({near}) d GROUP BY stratum, start, CAST(floor({BINS} * ln(d2 + 1e-9)) AS INT)"
    ranked = f"SELECT *, sum(k) OVER (PARTITION BY stratum, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k AS nearer FROM ({binned}) b"
    names = [f"s{i}" for i in _D] + [f"s{i}{j}" for i, j in _PAIRS]
    half = f"SELECT stratum, start, CAST(sum(k) AS DOUBLE) AS n, {', '.join(f'sum({c}) AS {c}' for c in names)} FROM ({ranked}) r WHERE 2 * nearer < n GROUP BY stratum, start"
    return _fit_sql(f"({half}) h_")


def _choice_sql(fits: str) -> str:
    """Each stratum's start of least determinant; the lowest start on a tie."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY round(det, 9), start) AS place FROM {fits}) c WHERE place = 1"


def _verdict_sql(stats: str, strata: str, fits: str, extra: str = "") -> str:
    """Every row's statistics and verdict; rows of a stratum of under MIN_STRATUM vectors stay."""
    made = ", ".join(f"CASE WHEN NOT s.base_failed THEN {e} END AS v{i}" for i, e in VECTOR.items())
    m = ", ".join([f"p.m{i}" for i in _D] + [f"p.l{i}{j}" for i, j in _PAIRS])
    rows = f"SELECT s.doc_id, {extra.format(t='s.')}{', '.join('s.' + c for c in _STATS)}, s.base_failed, {made}, {m} FROM {stats} s LEFT JOIN {strata} t ON s.lang = t.lang AND s.source = t.source LEFT JOIN {fits} p ON t.stratum = p.stratum"
    d2 = _distance_sql(rows, f"doc_id, {extra.format(t='')}{', '.join(_STATS)}, base_failed")
    return f"SELECT doc_id, {extra.format(t='')}{', '.join(_STATS)}, base_failed, CASE WHEN base_failed THEN false ELSE coalesce(d2 <= {CUTOFF}, true) END AS kept FROM ({d2}) k_"


def _judged(stats: DataFrame, carried: str = "") -> DataFrame:
    """doc_id, `carried`, the word statistics, base_failed and kept of each row of a written table of text_statistics()."""
    spark = stats.sparkSession
    slim = stats.select("lang", "source", *_STATS, "base_failed")
    strata = written(spark.sql(_strata_sql("{stats}").replace("VARCHAR(20)", "STRING"), stats=slim), "rules-strata")
    small = (lambda df: F.broadcast(df)) if strata.count() <= MOST_STRATA else (lambda df: df)
    hexed = "CAST(conv(substr({x}, 1, 8), 16, 10) AS DOUBLE) / 4294967296.0"
    sql = _vectors_sql("{stats}", "{strata}", hexed).replace("VARCHAR(20)", "STRING")
    vectors = written(spark.sql(sql, stats=slim, strata=small(strata)), "rules-vectors")
    fits = written(spark.sql(_start_sql("{v}"), v=vectors), "rules-fit")
    for step in range(FIRST_STEPS + LAST_STEPS):
        now = spark.sql(_choice_sql("{p}"), p=fits).drop("place") if step == FIRST_STEPS else fits
        old, fits = fits, written(spark.sql(_step_sql("{v}", "{p}"), v=vectors, p=small(now)), "rules-fit")
        discard(old)
    discard(vectors)
    extra = f"{{t}}{carried}, " if carried else ""
    return spark.sql(_verdict_sql("{stats}", "{strata}", "{p}", extra), stats=stats, strata=small(strata), p=small(fits))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the word statistics, base_failed and kept of each row of docs (columns doc_id, text, lang, source).

    A row is kept if it passes the base rules and its vector lies within CUTOFF of
    its stratum's estimate. The strata are (lang, source); those with fewer than
    MIN_STRATUM distinct vectors are pooled by lang, then over all; a pool that is
    still smaller rejects nothing. Only rows that pass the base rules are estimated
    from. Every such row counts, copies of a vector once, so no group of copies
    can become the half that sets the norm. Estimates are broadcast while there are
    at most MOST_STRATA, and each step sums over bins of distance, so a hot stratum
    is added up where its rows are. An empty table gives none.
    Rows of the same doc_id are judged each for itself; other columns are ignored.
    """
    return _judged(written(text_statistics(docs), "rules-statistics"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever those are named.

    Rows travel with their statistics, so no text is shuffled.
    """
    stats = written(text_statistics(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")), "rules-documents")
    return _judged(stats, "_doc").filter("kept").select("_doc.*")


def oracle_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of judge()."""
    space = r"[ \t\n\x0b\f\r]"
    parts = {
        "d_": f"SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM {documents}",
        "w_": rf"SELECT r, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS w FROM d_",
        "t_": "SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest([concat_ws(' ', w[k], w[k + 1], w[k + 2]) FOR k IN range(1, len(w) - 1)]) AS v FROM w_",
        "c_": "SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM t_",
        "p_": "SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM c_, (VALUES (0), (1), (2)) x(o) WHERE c > 1 GROUP BY r",
        "l_": rf"SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d_) WHERE regexp_replace(x, '{space}', '', 'g') <> '' GROUP BY r",
        "n_": rf"SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d_ JOIN w_ USING (r) LEFT JOIN p_ USING (r) LEFT JOIN l_ USING (r)",
        "stats_": f"SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM n_",
        "strata_": _strata_sql("stats_"),
        "vectors_": _vectors_sql("stats_", "strata_", "CAST(CAST(concat('0x', substr({x}, 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0"),
        "fit0_": _start_sql("vectors_"),
    }
    now = "fit0_"
    for step in range(FIRST_STEPS + LAST_STEPS):
        if step == FIRST_STEPS:
            parts["choice_"] = _choice_sql(now)
            now = "choice_"
        parts[f"fit{step + 1}_"] = _step_sql("vectors_", now)
        now = f"fit{step + 1}_"
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in parts.items()) + "\n" + _verdict_sql("stats_", "strata_", now)
