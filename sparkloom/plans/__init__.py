"""Registered queries: a Spark callable each, and the SQL that checks it."""

from sparkloom.plans.registry import Query, registered

__all__ = ["Query", "registered"]
