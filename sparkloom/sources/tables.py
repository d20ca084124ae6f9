"""The fixed table names of a data folder, read through Spark only; readers and writers by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The tables of a data folder.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
# Formats that Spark reads and writes without further jars.
FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; the folder may lie in any store that Spark reads."""
    if name not in TABLES:
        raise ValueError(f"no table named {name!r}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, folder: str) -> list[str]:
    """Make every table of a folder known to spark.sql() under its own name."""
    for name in TABLES:
        read_table(spark, folder, name).createOrReplaceTempView(name)
    return list(TABLES)


def read(spark: SparkSession, path: str, form: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A dataset of any of FORMATS. Text formats want a schema: inferring one reads all data once more."""
    if form not in FORMATS:
        raise ValueError(f"format {form!r} is none of {FORMATS}")
    if form in ("json", "csv") and schema is None:
        raise ValueError(f"{form} is read with a schema")
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, mode: str = "error", **options: str) -> None:
    """Write a dataset, in a folder for each value of `by` if given; rows of a value are dealt by it first, so files stay few."""
    if form not in FORMATS:
        raise ValueError(f"format {form!r} is none of {FORMATS}")
    if by:
        df = df.hint("rebalance", *by)
    writer = df.write.format(form).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> DataFrame:
    """Save as a table bucketed and sorted by keys: later joins and groups on them need no shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def stream(spark: SparkSession, path: str, schema: T.StructType, files_each: int = 1) -> DataFrame:
    """A Parquet folder as a stream of files; a single file may be named by a pattern, such as "name.parque[t]"."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)
