"""Shared helpers: scratch tables in the shared folder, Arrow plumbing."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_MADE: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset on one machine, as in tests, a folder of our own; on a
    cluster that is an error, since executors do not see each other's folders.
    """
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="sparkloom-"))
    return _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    _MADE.append(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this driver has put in the shared folder; call it when no result that reads from there is needed any more."""
    while _MADE:
        where = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there."""
    return written_at(df, scratch_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    """written() to a path of one's own choice below one that scratch_path() gave."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), when nothing reads it any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.removeprefix("file:").lstrip("/") in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def made() -> int:
    """How many paths in the shared folder this driver has named so far, for discard_made()."""
    return len(_MADE)


def discard_made(spark: SparkSession, since: int, *names: str) -> None:
    """Delete the tables of these names that were made after made() gave `since`; nothing may read them any more."""
    for path in _MADE[since:]:
        if path.rsplit("/", 1)[1].rsplit("-", 1)[0] in names:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def row_key(docs: DataFrame) -> F.Column:
    """A 64-bit hash of a document's id, text, language and source: with doc_id it names a row, but for rows alike in all four."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text", "lang", "source") if c in docs.columns))


def spread(df: DataFrame, least_mb: int = 4) -> DataFrame:
    """The rows dealt over all cores if the table is too small to have a row group for each; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * least_mb << 20 else df


def give_back() -> None:
    """Give freed memory of this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def settled(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The Arrow function `work`, which gives freed memory back when its partition is done: workers live on, beside a growing heap."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
