"""Queries over operators that write to the shared folder or work on whole tables in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import operators as O
from sparkloom.functions import extensions
from sparkloom.plans.registry import Query
from sparkloom.sources import read_table, settled_table, shared_path, write_shards

_ROWS, _SEED = 1000, 7
_LANGUAGES = ["de", "en", "es", "fr"]


def win_running_total(spark: SparkSession, folder: str) -> DataFrame:
    """Cents ordered so far, over all orders in order of key."""
    cents = read_table(spark, folder, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return O.running_total(cents, ["o_orderkey"], "cents")


def map_cogroup(spark: SparkSession, folder: str) -> DataFrame:
    """The user's purchase value at the time of each error, on the line between the purchases around it."""
    e = read_table(spark, folder, "events")
    out = O.interpolated(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'"), "user_id", "ts", "value")
    return out.select("event_id", F.round("interpolated", 4).alias("value"))


def agg_sketch_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Users by type and week, exact, and whether sketches that were stored by day and united come within 5 percent of them."""
    e = read_table(spark, folder, "events").select("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "user_id")
    daily = settled_table(e.groupBy("event_type", "day").agg(F.hll_sketch_agg("user_id", F.lit(14)).alias("sketch")), "daily-sketches")
    week = F.date_trunc("week", "day").cast("timestamp_ntz").alias("week")
    near = daily.groupBy("event_type", week).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    exact = e.groupBy("event_type", week).agg(F.countDistinct("user_id").alias("users"))
    return exact.join(near, ["event_type", "week"]).select("event_type", "week", "users", (F.abs(F.col("about") - F.col("users")) <= 0.05 * F.col("users")).alias("near"))


def sink_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as shards in a seeded order: the rows, first and last key and digest of each, from the files."""
    path = shared_path(spark, "order-shards")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    made = write_shards(orders, path, "o_orderkey", _ROWS, _SEED)
    back = spark.read.parquet(f"{path}/rows").groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.min_by("o_orderkey", "place").alias("first_key"), F.max_by("o_orderkey", "place").alias("last_key"), F.sum("o_custkey").alias("custkeys")
    )
    return made.join(back, "shard").select("shard", "n_rows", "first_key", "last_key", "custkeys")


def observe_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and characters by language that pass each of three filters, counted by the pass that writes those that pass all."""
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    stages = {"long enough": F.col("n_chars") >= 200, "not too long": F.col("n_chars") <= 5000, "even source": F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 2 == 0}
    kept, seen = O.observed_funnel(docs, stages, "lang", _LANGUAGES, "n_chars")
    kept.write.parquet(shared_path(spark, "funnel"))
    return spark.createDataFrame(O.funnel_rows(stages, _LANGUAGES, seen), "stage string, lang string, n long, chars long")


def udaf_trimmed_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The mean value of each user's events without the lowest and highest tenth."""
    e = read_table(spark, folder, "events").groupBy("user_id").agg(extensions.trimmed_mean("value").alias("mean"))
    return e.select("user_id", F.round("mean", 10).alias("mean"))


def udtf_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Bands of 200 between each brand's lowest and highest price, by a lateral call of the table function."""
    ends = read_table(spark, folder, "part").groupBy("p_brand").agg(F.floor(F.min("p_retailprice")).cast("double").alias("lo"), F.max("p_retailprice").alias("hi"))
    bands = extensions.Bands(F.col("lo").outer(), F.col("hi").outer(), F.lit(200.0))
    return ends.lateralJoin(bands).select("p_brand", "low", "high")


_STAGES = (("all", "true"), ("long enough", "n_chars >= 200"), ("not too long", "n_chars BETWEEN 200 AND 5000"), ("even source", "n_chars BETWEEN 200 AND 5000 AND CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 = 0"))
QUERIES: dict[str, Query] = {
    "win_running_total": Query(
        win_running_total,
        "SELECT o_orderkey, cents, CAST(sum(cents) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)",
    ),
    "map_cogroup": Query(
        map_cogroup,
        "WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), a AS (SELECT e.event_id, e.user_id, e.ts, p.ts AS t0, p.value AS v0 FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts), "
        "b AS (SELECT a.*, p.ts AS t1, p.value AS v1 FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.ts <= p.ts) SELECT event_id, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 4) AS value FROM b",
    ),
    "agg_sketch_rollup": Query(agg_sketch_rollup, "SELECT event_type, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY 1, 2"),
    "sink_shards": Query(
        sink_shards,
        f"WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('{_SEED}:' || o_orderkey::varchar), o_orderkey) AS place FROM orders) SELECT (place - 1) // {_ROWS} AS shard, count(*) AS n_rows, min_by(o_orderkey, place) AS first_key, max_by(o_orderkey, place) AS last_key, CAST(sum(o_custkey) AS BIGINT) AS custkeys FROM r GROUP BY 1",
    ),
    "udaf_trimmed_mean": Query(
        udaf_trimmed_mean,
        "SELECT user_id, round(avg(value), 10) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(value) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) WHERE k > n // 10 AND k <= n - n // 10 GROUP BY 1",
    ),
    "udtf_bands": Query(
        udtf_bands,
        "SELECT p_brand, lo + 200 * k AS low, least(hi, lo + 200 * (k + 1)) AS high FROM (SELECT p_brand, CAST(floor(min(p_retailprice)) AS DOUBLE) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1), LATERAL (SELECT unnest(range(0, CAST(ceil((hi - lo) / 200) AS BIGINT))) AS k)",
    ),
    "observe_funnel": Query(observe_funnel, " UNION ALL ".join(f"SELECT '{name}' AS stage, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE {keep} GROUP BY lang" for name, keep in _STAGES)),
}
