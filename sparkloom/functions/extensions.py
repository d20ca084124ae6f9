"""Functions of our own kind: scalar, aggregate and table functions on Arrow batches, for what Spark has no function for."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf


@pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, which Spark has no function for; null stays null."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@pandas_udf(T.DoubleType())
def trimmed_mean(x: pd.Series) -> float | None:
    """The mean without the lowest and the highest tenth, nulls left out. One group's values must fit a task."""
    x = x.dropna().sort_values()
    cut = len(x) // 10
    return None if x.empty else float(x.iloc[cut : len(x) - cut].mean())


@udtf(returnType=T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
class Bands:
    """Adjoining bands of a width from `low` up to `high`; none where the width is not above 0 or an argument is null."""

    def eval(self, low: float, high: float, width: float) -> Iterator[tuple[float, float]]:
        """The bands."""
        if None in (low, high, width) or width <= 0:
            return
        n = 0
        while low + n * width < high:
            yield low + n * width, min(high, low + (n + 1) * width)
            n += 1


def register(spark: SparkSession) -> None:
    """Make them known to SQL as nfc, trimmed_mean and bands."""
    spark.udf.register("nfc", nfc)
    spark.udf.register("trimmed_mean", trimmed_mean)
    spark.udtf.register("bands", Bands)
