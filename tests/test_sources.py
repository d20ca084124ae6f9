"""Round trips through every format, partitioned and bucketed tables."""

import pytest

from sparkloom.sources import FORMATS, bucketed, read, read_table, register_views, sequence, write
from tests.compare import SMALL


@pytest.mark.parametrize("form", [f for f in FORMATS if f != "text"])
def test_round_trip(spark, tmp_path, form):
    df = spark.createDataFrame([(1, "a,\"b\"", 2.5), (2, None, None), (3, "é", -1.0)], "k int, s string, x double")
    write(df, f"{tmp_path}/t", form, **({"header": "true", "escape": '"'} if form == "csv" else {}))
    back = read(spark, f"{tmp_path}/t", form, df.schema, **({"header": "true", "escape": '"'} if form == "csv" else {}))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_partitions_are_pruned(spark, tmp_path):
    write(read_table(spark, SMALL, "orders"), f"{tmp_path}/o", by=["o_orderstatus"])
    some = read(spark, f"{tmp_path}/o", "parquet").filter("o_orderstatus = 'F'")
    assert "PartitionFilters: [isnotnull(o_orderstatus" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == read_table(spark, SMALL, "orders").filter("o_orderstatus = 'F'").count()


def test_bucketed_join_has_no_shuffle(spark):
    o = bucketed(read_table(spark, SMALL, "orders"), "orders_b", ["o_orderkey"], 4)
    li = bucketed(read_table(spark, SMALL, "lineitem"), "lineitem_b", ["l_orderkey"], 4)
    plan = o.hint("merge").join(li, o.o_orderkey == li.l_orderkey)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_wrong_names(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, SMALL, "nowhere")
    with pytest.raises(ValueError):
        read(spark, str(tmp_path), "csv")


def test_sql_over_views(spark):
    register_views(spark, SMALL)
    got = spark.sql("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
    assert got.count() == 5 and sum(r.n for r in got.collect()) == 25


def test_source_in_python(spark):
    sequence.register(spark)
    df = spark.read.format("sequence").option("start", 3).option("end", 20).option("partitions", 4).load()
    assert sorted(r.id for r in df.collect()) == list(range(3, 20)) and df.rdd.getNumPartitions() == 4
    assert spark.read.format("sequence").option("end", 0).load().count() == 0
