"""Every registered query outside llm against its SQL."""

import pytest

from sparkloom.plans import registered
from tests.compare import SMALL, duck_rows, rows_of

ALL = registered()


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if q.sql])
def test_against_sql(spark, name):
    df = ALL[name].run(spark, SMALL)
    assert rows_of(df) == duck_rows(ALL[name].sql)


def test_sketch_is_near(spark):
    got = {r.l_returnflag: r.orders for r in ALL["agg_approx_distinct"].run(spark, SMALL).collect()}
    exact = {r.l_returnflag: r.orders for r in ALL["agg_distinct"].run(spark, SMALL).collect()}
    assert all(abs(got[k] - exact[k]) <= 0.05 * exact[k] for k in exact)


def test_scan_pushes_down(spark):
    plan = ALL["scan_parquet"].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
    assert "l_extendedprice" not in plan


@pytest.mark.parametrize("name", ["join_asof", "join_range", "join_interval", "topk_per_group"])
def test_no_products(spark, name):
    plan = ALL[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
