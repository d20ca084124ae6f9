"""Relational queries over the star schema and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import operators as O
from sparkloom.functions import bucket, day_of, json_int, money, word_count
from sparkloom.plans.registry import Query
from sparkloom.sources import read_table

QUERIES: dict[str, Query] = {}
Tables = Callable[[str], DataFrame]


def _query(sql: str | None) -> Callable:
    """Register a function of the tables under its own name."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(lambda name: read_table(spark, folder, name))

        QUERIES[build.__name__] = Query(run, sql)
        return build

    return add


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


@_query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01' AND l_quantity < 10")
def scan_parquet(t: Tables) -> DataFrame:
    """Filters and columns that reach the scan."""
    early, late = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-07-01").cast("timestamp_ntz")
    return t("lineitem").filter((F.col("l_shipdate") >= early) & (F.col("l_shipdate") < late) & (F.col("l_quantity") < 10)).select("l_orderkey", "l_partkey", "l_quantity")


@_query(
    "SELECT o_orderkey, CAST(o_totalprice * CAST(1.1 AS DOUBLE) AS DOUBLE) AS gross, CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'medium' ELSE 'small' END AS size "
    "FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"
)
def filter_project(t: Tables) -> DataFrame:
    """Predicates, computed columns and cases."""
    o = t("orders").filter((F.col("o_orderstatus") != "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    size = F.when(F.col("o_totalprice") >= 200000, "large").when(F.col("o_totalprice") >= 50000, "medium").otherwise("small")
    return o.select("o_orderkey", (F.col("o_totalprice") * 1.1).alias("gross"), size.alias("size"))


@_query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, "
    "round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"
)
def pricing_summary(t: Tables) -> DataFrame:
    """Sums and averages by two flags."""
    item = t("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return item.groupBy("l_returnflag", "l_linestatus").agg(
        money(F.sum("l_quantity")).alias("sum_qty"),
        money(F.sum("l_extendedprice")).alias("sum_base"),
        money(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        _n(),
    )


@_query(
    "SELECT n_name, c_mktsegment, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey "
    "JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"
)
def join_inner_star(t: Tables) -> DataFrame:
    """A star join: orders meet the small sides first, then the lines, and one aggregate by segment follows."""
    people = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(t("nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(people, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "n_name", "c_mktsegment")
    # tenths of a thousandth as whole numbers: their sum is exact, and half as dear as that of decimals
    price = F.round((F.col("l_extendedprice") * (1 - F.col("l_discount"))) * 10_000).cast("bigint")
    lines = t("lineitem").select("l_orderkey", price.alias("r"))
    j = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("n_name", "c_mktsegment")
    return j.agg((F.sum("r") / 10_000).alias("revenue"), _n())


@_query("SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_left_outer(t: Tables) -> DataFrame:
    """Orders with their lines, none too."""
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("lines"))


@_query("SELECT p_partkey, l_partkey, count(*) AS n FROM (SELECT * FROM part WHERE p_size > 25) p FULL JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON p_partkey = l_partkey GROUP BY 1, 2")
def join_full_outer(t: Tables) -> DataFrame:
    """Parts and lines, whichever is missing."""
    j = t("part").filter("p_size > 25").join(t("lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "full")
    return j.groupBy("p_partkey", "l_partkey").agg(_n())


@_query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem RIGHT JOIN supplier ON l_suppkey = s_suppkey AND l_quantity > 49 GROUP BY 1, 2")
def join_right_outer(t: Tables) -> DataFrame:
    """Suppliers with their large lines."""
    j = t("lineitem").join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("l_quantity") > 49), "right")
    return j.groupBy("l_partkey", "l_suppkey").agg(_n())


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi(t: Tables) -> DataFrame:
    """Customers with a large order."""
    return t("customer").join(t("orders").filter("o_totalprice > 100000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(t: Tables) -> DataFrame:
    """Orders without lines."""
    return t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@_query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t: Tables) -> DataFrame:
    """A join by order only, of a table that has a nation a row."""
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@_query("SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR")
def join_interval(t: Tables) -> DataFrame:
    """Purchases within an hour of a view by the same user."""
    e = t("events")
    v = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("vt"))
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("pt"))
    return O.interval_join(v, p, ["user_id"], "vt", "pt", "1 hour").select("view_id", "purchase_id")


@_query(
    "SELECT p.event_id, v.event_id AS event_id_asof FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"
)
def join_asof(t: Tables) -> DataFrame:
    """Each purchase with the user's latest view."""
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    left, right = e.filter("event_type = 'purchase'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type")
    return O.asof_join(left, right, ["user_id"], "ts", ["event_id"]).select("event_id", "event_id_asof")


@_query("SELECT o_orderkey, band FROM orders JOIN (SELECT p_partkey AS band, p_retailprice * 100 AS low, p_retailprice * 100 + 40 AS high FROM part WHERE p_partkey <= 200) ON o_totalprice >= low AND o_totalprice < high")
def join_range(t: Tables) -> DataFrame:
    """Orders in price bands, by bins."""
    bands = t("part").filter("p_partkey <= 200").select(F.col("p_partkey").alias("band"), (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 40).alias("high"))
    return O.range_join(t("orders"), bands, "o_totalprice", "low", "high", 200.0).select("o_orderkey", "band")


@_query("SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def join_salted(t: Tables) -> DataFrame:
    """A join with its hot keys dealt out."""
    lines = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").withColumnRenamed("l_suppkey", "s_suppkey")
    return O.salted_join(lines, t("supplier"), ["s_suppkey"], 8).groupBy("s_name").agg(_n())


@_query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_distinct(t: Tables) -> DataFrame:
    """Several distinct counts."""
    return t("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


_LEVELS = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g1, CAST(grouping(l_linestatus) AS INT) AS g2, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY "


def _levels(grouped) -> DataFrame:
    return grouped.agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), _n(), money(F.sum("l_quantity")).alias("q"))


@_query(_LEVELS + "ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t: Tables) -> DataFrame:
    """Totals at each level."""
    return _levels(t("lineitem").rollup("l_returnflag", "l_linestatus"))


@_query(_LEVELS + "CUBE (l_returnflag, l_linestatus)")
def agg_cube(t: Tables) -> DataFrame:
    """Totals over every subset."""
    return _levels(t("lineitem").cube("l_returnflag", "l_linestatus"))


@_query(_LEVELS + "GROUPING SETS ((l_returnflag), (l_linestatus))")
def agg_grouping_sets(t: Tables) -> DataFrame:
    """Totals over chosen subsets."""
    return _levels(t("lineitem").groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus"))


@_query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def agg_quantile(t: Tables) -> DataFrame:
    """Exact quantiles, by counts of values and running counts."""
    q = O.exact_quantiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"med": 0.5, "p90": 0.9})
    return q.select("l_returnflag", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"))


@_query(None)
def agg_approx_distinct(t: Tables) -> DataFrame:
    """Distinct orders by sketch."""
    return t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.01).alias("orders"))


@_query(
    "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in ("view", "signup", "purchase", "error", "click")) + " FROM events GROUP BY 1"
)
def agg_pivot(t: Tables) -> DataFrame:
    """Event types as columns."""
    return O.pivot_counts(t("events"), ["user_id"], "event_type", ["view", "signup", "purchase", "error", "click"])


@_query("SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_part(t: Tables) -> DataFrame:
    """Columns as rows."""
    return O.unpivot(t("part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey"], ["p_size", "p_retailprice"])


@_query("SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS big, min(l_shipdate) AS first, max(l_shipdate) AS last, bool_or(l_discount > 0.09) AS deep, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def agg_filtered(t: Tables) -> DataFrame:
    """Conditional, extreme and statistical aggregates."""
    return t("lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_quantity") > 25).alias("big"),
        F.min("l_shipdate").alias("first"),
        F.max("l_shipdate").alias("last"),
        F.bool_or(F.col("l_discount") > 0.09).alias("deep"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"),
    )


@_query("SELECT o_custkey, CAST(list_sort(list(DISTINCT o_orderstatus)) AS VARCHAR[]) AS states FROM orders GROUP BY 1")
def agg_collect(t: Tables) -> DataFrame:
    """Sorted sets."""
    return t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("states"))


@_query(
    "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER v AS INT) AS rk, CAST(dense_rank() OVER v AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS nt "
    "FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)"
)
def win_rank(t: Tables) -> DataFrame:
    """Ranking functions."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    v = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t("orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.ntile(4).over(w).alias("nt"))


@_query("SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after2, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) AS BIGINT) AS gap_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(t: Tables) -> DataFrame:
    """The row before, the one after next, and the time between."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type", 2).over(w).alias("after2"), (us - F.lag(us).over(w)).alias("gap_us"))


@_query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean3 FROM events")
def win_rows_frame(t: Tables) -> DataFrame:
    """Running and moving aggregates over rows."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", money(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("total"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 4).alias("mean3"))


@_query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hour_n FROM events")
def win_range_frame(t: Tables) -> DataFrame:
    """Events of the last hour."""
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    w = Window.partitionBy("user_id").orderBy(s).rangeBetween(-3600, 0)
    return t("events").select("event_id", F.count(F.lit(1)).over(w).alias("hour_n"))


@_query("SELECT event_id, first_value(event_type) OVER w AS first_type, nth_value(event_type, 2) OVER w AS second_type, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), v AS (PARTITION BY user_id ORDER BY value)")
def win_values(t: Tables) -> DataFrame:
    """First and n-th values, and relative ranks."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = Window.partitionBy("user_id").orderBy("value")
    return t("events").select("event_id", F.first("event_type").over(w).alias("first_type"), F.nth_value("event_type", 2).over(w).alias("second_type"), F.round(F.percent_rank().over(v), 6).alias("pr"), F.round(F.cume_dist().over(v), 6).alias("cd"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t: Tables) -> DataFrame:
    """The largest orders."""
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@_query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    """Three orders of each customer."""
    return O.top_k_per_group(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@_query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def latest_row(t: Tables) -> DataFrame:
    """The latest event of each user and type (ids are in time order)."""
    return O.latest_per_key(t("events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts"]).select("user_id", "event_type", "event_id")


@_query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables) -> DataFrame:
    """Either, once."""
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@_query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(t: Tables) -> DataFrame:
    """Both, all rows."""
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey"))


@_query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(t: Tables) -> DataFrame:
    """In both."""
    o = t("orders").select("o_orderstatus", F.col("o_custkey").alias("k"))
    return o.filter("o_orderstatus = 'F'").select("k").intersect(o.filter("o_orderstatus = 'O'").select("k"))


@_query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def set_except(t: Tables) -> DataFrame:
    """In the first only."""
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").filter("o_totalprice > 150000").select("o_custkey"))


@_query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 30 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity < 20")
def set_except_all(t: Tables) -> DataFrame:
    """In the first more often."""
    li = t("lineitem").select("l_quantity", F.col("l_partkey").alias("k"))
    return li.filter("l_quantity > 30").select("k").exceptAll(li.filter("l_quantity < 20").select("k"))


@_query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
def subq_correlated(t: Tables) -> DataFrame:
    """Lines far below their part's average."""
    li = t("lineitem")
    mean = li.groupBy("l_partkey").agg((0.2 * F.avg("l_quantity")).alias("m"))
    return li.join(mean, "l_partkey").filter("l_quantity < m").select("l_orderkey", "l_partkey", "l_quantity")


@_query("WITH RECURSIVE d(i, day) AS (SELECT 0, DATE '2024-01-01' UNION ALL SELECT i + 1, day + 1 FROM d WHERE i < 30) SELECT CAST(day AS DATE) AS day, count(event_id) AS n FROM d LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY 1")
def cte_recursive(t: Tables) -> DataFrame:
    """Days by recursion, with their events."""
    e = t("events")
    return e.sparkSession.sql(
        "WITH RECURSIVE d(i, day) AS (SELECT 0, DATE '2024-01-01' UNION ALL SELECT i + 1, date_add(day, 1) FROM d WHERE i < 30) SELECT day, count(event_id) AS n FROM d LEFT JOIN {e} ON CAST(ts AS DATE) = day GROUP BY day", e=e
    )


@_query("SELECT doc_id, lower(lang) AS l, substr(source, 4, 2) AS s, replace(source, 'src', 'origin-') AS o, lpad(source, 8, '_') AS p, CAST(strlen(text) AS BIGINT) AS bytes, md5(text) AS h, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+')) AS BIGINT) AS words FROM documents")
def fn_string(t: Tables) -> DataFrame:
    """String functions."""
    return t("documents").select(
        "doc_id", F.lower("lang").alias("l"), F.substring("source", 4, 2).alias("s"), F.replace("source", F.lit("src"), F.lit("origin-")).alias("o"), F.lpad("source", 8, "_").alias("p"),
        F.octet_length("text").cast("bigint").alias("bytes"), F.md5("text").alias("h"), word_count("text").alias("words"),
    )


@_query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS day, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(week(o_orderdate) AS INT) AS w, CAST(last_day(o_orderdate) AS DATE) AS eom, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS since FROM orders")
def fn_date(t: Tables) -> DataFrame:
    """Date functions."""
    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", day_of("o_orderdate").alias("day"), F.year(d).alias("y"), F.quarter(d).alias("q"), F.weekofyear(d).alias("w"), F.last_day(d).alias("eom"), F.date_add(d, 30).alias("due"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("since"))


@_query("SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS k, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 6) AS log, CAST(o_orderkey % 7 AS BIGINT) AS m, abs(o_totalprice - 100000) AS dist, greatest(o_totalprice, 100000.0) AS g, CAST(sign(o_totalprice - 100000) AS INT) AS sg FROM orders")
def fn_math(t: Tables) -> DataFrame:
    """Mathematical functions."""
    p = F.col("o_totalprice")
    return t("orders").select("o_orderkey", bucket(p, 1000).alias("k"), F.round(F.sqrt(p), 6).alias("root"), F.round(F.ln(p), 6).alias("log"), (F.col("o_orderkey") % 7).alias("m"), F.abs(p - 100000).alias("dist"), F.greatest(p, F.lit(100000.0)).alias("g"), F.signum(p - 100000).cast("int").alias("sg"))


@_query("SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(list_max(embedding), 6) AS hi, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS pos, round(CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS DOUBLE), 4) AS norm2 FROM embeddings")
def fn_array(t: Tables) -> DataFrame:
    """Array functions."""
    e = F.col("embedding")
    norm = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return t("embeddings").select("vec_id", F.size(e).alias("n"), F.round(F.array_max(e), 6).alias("hi"), F.size(F.filter(e, lambda x: x > 0)).alias("pos"), F.round(norm, 4).alias("norm2"))


@_query("SELECT user_id, k, n FROM (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2) WHERE n >= 2")
def fn_map(t: Tables) -> DataFrame:
    """Maps of counts, filtered and taken apart."""
    n = t("events").groupBy("user_id", "event_type").agg(_n())
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.explode(F.map_filter("m", lambda k, v: v >= 2)).alias("k", "n"))


@_query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def fn_json(t: Tables) -> DataFrame:
    """Counts by a member of a JSON text."""
    return t("events").groupBy(json_int("props", "$.k").alias("k")).agg(_n())


@_query("SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))")
def sessionize(t: Tables) -> DataFrame:
    """Sessions by gaps of half an hour."""
    return O.sessions(t("events"), "user_id", "ts", "30 minutes").select("event_id", "session")


@_query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (role = 'assistant') AS replies, max_by(role, turn) AS last_role FROM conversations GROUP BY 1")
def conv_stats(t: Tables) -> DataFrame:
    """Figures of each conversation."""
    return t("conversations").groupBy("conv_id").agg(_n("turns"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "assistant").alias("replies"), F.max_by("role", "turn").alias("last_role"))


@_query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def corpus_by_language(t: Tables) -> DataFrame:
    """Documents, characters and labels by language."""
    return t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id", "left").groupBy("lang").agg(_n(), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"))
