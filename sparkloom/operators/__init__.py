"""Relational operators beyond single DataFrame calls."""

from sparkloom.operators.funnel import funnel_rows, observed_funnel
from sparkloom.operators.joins import asof_join, interval_join, range_join, salted_join
from sparkloom.operators.ordered import interpolated, running_total
from sparkloom.operators.shaping import exact_quantiles, latest_per_key, pivot_counts, sessions, top_k_per_group, unpivot

__all__ = ["asof_join", "exact_quantiles", "funnel_rows", "interpolated", "interval_join", "latest_per_key", "observed_funnel", "pivot_counts", "range_join", "running_total", "salted_join", "sessions", "top_k_per_group", "unpivot"]
