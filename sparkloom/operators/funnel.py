"""Counts along a chain of filters, from the same pass that writes the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed_funnel(df: DataFrame, stages: dict[str, Column], by: str, values: list[str], size: str) -> tuple[DataFrame, list[Observation]]:
    """The rows that pass all stages, and an observation for df and after each stage.

    Each observation counts rows and sums `size` for every one of `values` in column
    `by`, and for all others (nulls too) together. Counting rides on whatever action runs
    over the rows, so nothing is read twice; a stage's filter that is null drops the row.
    """
    seen = []
    for keep in (None, *stages.values()):
        df = df if keep is None else df.filter(keep)
        seen.append(Observation())
        own = [F.coalesce(F.col(by) == v, F.lit(False)) for v in values]
        rest = ~F.coalesce(F.col(by).isin(values), F.lit(False))
        counts = [c for i, at in enumerate([*own, rest]) for c in (F.count_if(at).alias(f"n{i}"), F.sum(F.when(at, F.col(size))).alias(f"s{i}"))]
        df = df.observe(seen[-1], *counts)
    return df, seen


def funnel_rows(stages: dict[str, Column], values: list[str], seen: list[Observation], first: str = "all") -> list[tuple[str, str | None, int, int]]:
    """stage, value (null: others), rows and size, of what has been seen; groups without rows are left out. Waits for the action."""
    out = []
    for stage, o in zip((first, *stages), seen, strict=True):
        got = o.get
        out += [(stage, v, got[f"n{i}"], got[f"s{i}"] or 0) for i, v in enumerate([*values, None]) if got.get(f"n{i}")]
    return out
