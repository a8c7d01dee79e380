"""JSON shards of bounded size with a manifest of what was written, and artifacts bound to the data that they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.canonical import row_digests, tree_root
from millrace.functions.hashing import bucket
from millrace.functions.text import column
from millrace.operators.segments import fit_segments

#: The bytes that a shard may have, and how many shards there may be.
MOST_BYTES, MOST_SHARDS = 2 << 20, 4096
#: Bytes that a shard's own fields are meant to need at most.
FRAME = 512


def shards(products: DataFrame, key: str, buckets: int, most_bytes: int = MOST_BYTES, most_shards: int = MOST_SHARDS) -> DataFrame:
    """(shard, key, json) of products: dealt by the first 8 hex digits of their key, in order of key; what does not fit a
    bucket's shard goes to overflow shards, numbered after the buckets. One product that is too large by itself, or too many
    shards, are errors."""
    body = F.to_json(F.struct(*sorted(products.columns)), {"ignoreNullFields": "false"})
    rows = products.select(F.col(key).cast("string").alias("key"), body.alias("json")).withColumn("size", F.octet_length("json") + 1)
    rows = rows.withColumn("bucket", bucket("key", buckets))
    rows = fit_segments(rows, "bucket", ["key"], "size", most_bytes - FRAME)
    more = rows.where("segment > 0").groupBy("bucket", "segment").agg(F.min("key").alias("first"))
    n = more.count()
    if buckets + n > most_shards:
        raise ValueError(f"{buckets + n} shards, of {most_shards} at most")
    numbered = more.select("bucket", "segment", (F.row_number().over(Window.orderBy("first")) - 1 + buckets).alias("overflow"))  # most_shards rows at most
    return rows.join(F.broadcast(numbered), ["bucket", "segment"], "left").select(F.coalesce("overflow", "bucket").cast("int").alias("shard"), "key", "json")


def documents(dealt: DataFrame, generation: str) -> DataFrame:
    """(shard, document): one JSON text a shard, of bounded size."""
    held = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("key", "json"))).alias("rows"))
    head = F.concat(F.lit('{"generation_id":"' + generation + '","shard":'), F.col("shard"), F.lit(',"product_count":'), F.col("n"), F.lit(',"products":['))
    return held.select("shard", F.concat(head, F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit("]}")).alias("document"))


def write(documents: DataFrame, folder: str) -> DataFrame:
    """Write a file a shard and give the manifest of what is there."""
    documents.repartition("shard").select("shard", F.col("document").alias("value")).write.mode("overwrite").partitionBy("shard").text(folder)
    return manifest(documents.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, bytes, sha256, generation_id, product_count) of the files as they are read back."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    text = F.decode("content", "UTF-8")
    return files.select(
        F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("int").alias("shard"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
        F.get_json_object(text, "$.generation_id").alias("generation_id"), F.get_json_object(text, "$.product_count").cast("long").alias("product_count"),
    )


def differences(expected: DataFrame, found: DataFrame, generation: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(shard, reason) of all that is wrong: files missing, unexpected, changed, too large, of another generation."""
    e, f = expected.alias("e"), found.alias("f")
    both = e.join(f, F.col("e.shard") == F.col("f.shard"), "full_outer")
    own = F.col("f.shard").isNotNull()
    rules = [
        ("missing", ~own), ("unexpected", F.col("e.shard").isNull()), ("digest", own & (F.col("e.sha256") != F.col("f.sha256"))), ("bytes", own & (F.col("e.bytes") != F.col("f.bytes"))),
        ("count", own & ~F.col("e.product_count").eqNullSafe(F.col("f.product_count"))), ("generation", own & ~F.col("f.generation_id").eqNullSafe(F.lit(generation))), ("too_large", F.col("f.bytes") > most_bytes),
    ]
    reasons = F.array_compact(F.array(*(F.when(hit & (F.col("e.shard").isNotNull() | F.lit(name in ("unexpected", "generation", "too_large"))), name) for name, hit in rules)))
    return both.select(F.coalesce("e.shard", "f.shard").alias("shard"), F.explode(reasons).alias("reason"))


def bound(documents: DataFrame, unmatched: DataFrame, catalog: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row that binds an artifact to the catalogue and the profiles that it was made from: their digests, and counts."""
    one = lambda df, name: tree_root(row_digests(df)).select(F.col("root").alias(f"{name}_sha256"), F.col("leaves").alias(f"{name}_count"))
    counts = documents.agg(F.count("*").alias("mapped_document_count"))
    others = unmatched.agg(F.count("*").alias("unmatched_count"), F.count_if(F.col("reason") == "ambiguous_product_match").alias("ambiguous_count"))
    return _beside(one(catalog, "catalog"), one(profiles, "profiles"), counts, others)


def _beside(*frames: DataFrame) -> DataFrame:
    """Frames of one row as one row."""
    out, *others = (df.withColumn("__one", F.lit(1)) for df in frames)
    for df in others:
        out = out.join(df, "__one")
    return out.drop("__one")


SCOPES = ["variant", "weight", "batch", "product", "vendor"]


def violations(artifact: DataFrame, documents: DataFrame, unmatched: DataFrame, catalog: DataFrame, profiles: DataFrame) -> DataFrame:
    """(check, key) of all that an artifact breaks: bindings, counts, documents of products that the catalogue has not, scopes,
    addresses. documents: vendor_id, source_product_id, scope, url; catalog has the first two too."""
    now = bound(documents, unmatched, catalog, profiles)
    names = now.columns
    pair = _beside(artifact.select(F.struct(*names).alias("was")), now.select(F.struct(*names).alias("now")))
    broken = F.array_compact(F.array(*(F.when(~F.col(f"was.{n}").eqNullSafe(F.col(f"now.{n}")), n) for n in names)))
    out = pair.select(F.explode(broken).alias("check"), F.lit("").alias("key"))
    target = F.concat_ws("/", "vendor_id", "source_product_id")
    absent = documents.join(catalog.select("vendor_id", "source_product_id").distinct(), ["vendor_id", "source_product_id"], "left_anti")
    for name, rows in (("target", absent), ("scope", documents.where(~column("scope").isin(SCOPES))), ("url", documents.where(~column("url").rlike("^https?://")))):
        out = out.unionByName(rows.select(F.lit(name).alias("check"), target.alias("key")))
    return out
