"""Spark results against DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

from sparkloom.sources import TABLES

SMALL = "/root/testdata/sf0.001"


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


def rows_of(df: DataFrame) -> list[str]:
    cols = sorted(df.columns)
    return sorted(str([_plain(r[c]) for c in cols]) for r in df.collect())


def duck_rows(sql: str, folder: str = SMALL, **tables) -> list[str]:
    con = duckdb.connect()
    for t in TABLES:
        if t in tables:
            con.register(t, tables[t])
        else:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.sql(sql)
    order = [got.columns.index(c) for c in sorted(got.columns)]
    return sorted(str([_plain(r[i]) for i in order]) for r in got.fetchall())
