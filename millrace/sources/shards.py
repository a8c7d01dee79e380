"""JSON shard files: {schema_version, shard, products: [...], sources: [...]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFER = "id string, source_id string, vendor string, name string, url string, price string, original_price string, grams string, availability string, variant string, collected_at string"
SHARD = f"schema_version string, shard int, products array<struct<{OFFER.replace(' string', ':string')}>>, sources array<struct<source_id:string,name:string,admitted:boolean,status:string>>"


def read_shards(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """All shard-*.json below the folder, strictly: broken JSON, NaN and other versions are errors, and so are none."""
    reader = spark.read.schema(SHARD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "shard-*.json").option("mode", "FAILFAST").option("allowNonNumericNumbers", False)
    shards = reader.json(folder).withColumn("file", F.col("_metadata.file_path"))
    wrong = shards.where(F.coalesce(F.col("schema_version") != version, F.lit(True))).select("file").limit(1).collect()
    if wrong:
        raise ValueError(f"not of schema version {version}: {wrong[0].file}")
    if shards.isEmpty():
        raise FileNotFoundError(f"no shard in {folder}")
    return shards


def offers(shards: DataFrame) -> DataFrame:
    """The union of all products, with their file and place in it (for "first" and "last" rules)."""
    return shards.select("file", F.posexplode("products").alias("place", "p")).select("file", "place", "p.*")


def admitted(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows of admitted sources only."""
    sources = shards.select(F.explode("sources").alias("s")).where("s.admitted").select("s.source_id").distinct()
    return rows.join(sources, "source_id", "left_semi")


def flatten(records: DataFrame, child: str) -> DataFrame:
    """One row a child, whose fields override its parent's; parents without children stay as they are."""
    fields = [f.name for f in records.schema[child].dataType.elementType.fields]
    rows = records.withColumn("__c", F.explode_outer(child)).drop(child)
    kept = [F.coalesce(F.col(f"__c.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns if c != child]
    return rows.select(*kept, *(F.col(f"__c.{f}").alias(f) for f in fields if f not in records.columns))
