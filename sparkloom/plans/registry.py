"""One registry for the queries of every family."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A named query; sql is None where SQL cannot express its result."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def registered() -> dict[str, Query]:
    """All queries outside the llm subpackage, by name."""
    from sparkloom.plans import pipelines, relational, streams

    out: dict[str, Query] = {}
    for family in (relational.QUERIES, streams.QUERIES, pipelines.QUERIES):
        if clash := out.keys() & family.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= family
    return out
