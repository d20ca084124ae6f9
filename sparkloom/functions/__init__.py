"""Functions on columns, built from Spark's own."""

from sparkloom.functions.columns import bucket, day_of, json_int, money, safe_divide, word_count

__all__ = ["bucket", "day_of", "json_int", "money", "safe_divide", "word_count"]
