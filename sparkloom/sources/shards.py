"""Shards of bounded size in a seeded order, with a manifest, put in place at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ranked(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add place (from 1), a row's place in the order that the seed gives: by the MD5 of seed, colon and key, then by key."""
    from sparkloom.operators.ordered import running_total

    drawn = df.drop("place").withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))).withColumn("_one", F.lit(1).cast("long"))
    return running_total(drawn, ["_draw", key], "_one", "place").drop("_draw", "_one")


def write_shards(df: DataFrame, path: str, key: str, rows: int, seed: int = 7) -> DataFrame:
    """Write df as shards of `rows` rows each (the last may have fewer) and return the manifest: shard, n_rows, digest.

    Rows are put in one order over the whole table by a hash of seed and key, which names
    rows; so a rerun gives the same shards, whatever the partitions were. Shards are
    written beside `path`, read back for their counts and digests (the sum of a 64-bit
    hash of each row, which an order does not change), and with the manifest renamed to
    `path` at the end: a reader sees all or nothing, and a run that fails leaves no
    `path`. A null key is a key; columns named place or shard are replaced; an empty table
    gives an empty manifest. An existing `path` is an error.
    """
    spark = df.sparkSession
    fs, here = _place(spark, path)
    if fs.exists(here):
        raise FileExistsError(path)
    draft = f"{path.rstrip('/')}.draft"
    fs.delete(_place(spark, draft)[1], True)
    placed = ranked(df.drop("shard"), key, seed).withColumn("shard", F.floor((F.col("place") - 1) / rows))
    placed.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(f"{draft}/rows")
    back = read_shards(spark, draft, placed.schema)
    plain = [c for c in back.columns if c not in ("place", "shard") and "map<" not in dict(back.dtypes)[c]]
    digest = F.sum(F.xxhash64(*plain).cast("decimal(38,0)")).alias("digest")
    back.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), digest).coalesce(1).write.parquet(f"{draft}/manifest")
    if not fs.rename(_place(spark, draft)[1], here):
        raise OSError(f"{draft} could not be renamed to {path}")
    return manifest(spark, path)


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_shards(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of all shards, with place and shard."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path.rstrip('/')}/rows")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, n_rows and digest of each shard."""
    return spark.read.schema("shard long, n_rows long, digest decimal(38,0)").parquet(f"{path.rstrip('/')}/manifest")
