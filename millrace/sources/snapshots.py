"""Immutable, content-addressed snapshots of a table: written aside, verified, then pointed at.

A snapshot is a folder of Parquet shards; its id is a digest of the rows' digests. The pointer is a small table to which a
numbered row is appended last; readers take the one of the highest number, so they see the old or the new snapshot, never a
part of one, and at no time none. Earlier rows and snapshots stay, so one can go back.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import bucket


def content_id(df: DataFrame) -> str:
    """32 hex digits that depend on the rows and not on their order: two sums of halves of their digests, and the count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    halves = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16, 31)]
    sums = df.agg(F.count("*"), *halves).first()
    return df.sparkSession.range(1).select(F.substring(F.sha2(F.lit("|".join(map(str, sums))), 256), 1, 32)).first()[0]


def write(df: DataFrame, root: str, key: str, shards: int) -> str:
    """Write the rows dealt to shards by key, and then the pointer. Returns the snapshot's id. One writer at a time."""
    spark = df.sparkSession
    snapshot = content_id(df)
    out = df.withColumn("shard", bucket(F.sha2(F.col(key).cast("string"), 256), shards))
    out.repartition("shard").sortWithinPartitions("shard", key).write.mode("overwrite").partitionBy("shard").parquet(f"{root}/{snapshot}")
    found = content_id(spark.read.parquet(f"{root}/{snapshot}").select(*df.columns))
    if found != snapshot:
        raise ValueError(f"snapshot {snapshot} reads back as {found}")
    past = history(spark, root)
    spark.createDataFrame([(len(past), snapshot)], "number long, snapshot string").coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return snapshot


def history(spark: SparkSession, root: str) -> list[str]:
    """All snapshots that the pointer named, the latest last; a row a publication."""
    try:
        rows = spark.read.schema("number long, snapshot string").parquet(f"{root}/pointers").orderBy("number", "snapshot").collect()
    except AnalysisException:  # no pointer yet
        return []
    return [r.snapshot for r in rows]


def read(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    """The current snapshot, or the one `back` publications before it."""
    return spark.read.parquet(f"{root}/{history(spark, root)[-1 - back]}")


def lookup(spark: SparkSession, root: str, key: str, value: str, shards: int) -> DataFrame:
    """One key's rows, from its shard's files only."""
    shard = spark.range(1).select(bucket(F.sha2(F.lit(str(value)), 256), shards)).first()[0]
    return read(spark, root).where((F.col("shard") == shard) & (F.col(key) == value))


def manifest(df: DataFrame, key: str) -> DataFrame:
    """(shard, rows, first_key, last_key, digest) of a snapshot's rows."""
    row = F.xxhash64(*sorted(df.columns))
    return df.groupBy("shard").agg(F.count("*").alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.bit_xor(row).alias("digest"))
