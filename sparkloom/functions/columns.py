"""Small column functions with one meaning in every query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column | str, digits: int = 2) -> Column:
    """A rounded amount."""
    return F.round(x, digits)


def day_of(ts: str) -> Column:
    """The day of a timestamp, without a time zone."""
    return F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")


def json_int(column: str, path: str) -> Column:
    """An integer in a JSON text; null where there is none."""
    return F.get_json_object(column, path).try_cast("bigint")


def word_count(text: str) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+")).cast("bigint")


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def bucket(x: Column, width: float) -> Column:
    """The number of the bucket of so wide a range."""
    return F.floor(x / width).cast("bigint")
