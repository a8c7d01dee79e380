"""Products of one vendor that share an address are one: the best is kept, and the variants of all of them are united.

Which is best, and which of two variants, is decided by ranks that end in an identity, so results never depend on the order
of input. All steps are partial aggregations or windows on a product's own variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far each kind of identity is to be trusted.
AUTHORITY = {"source_product_identity": 4, "canonical_storefront_handle": 3, "canonical_product_url": 2, "conservative_vendor_title_fallback": 1}


def authority(method: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in AUTHORITY.items() for x in pair))
    return F.coalesce(F.try_element_at(table, method), F.lit(0))


def selected(products: DataFrame, variants: DataFrame) -> DataFrame:
    """(product_id, kept_id, candidates): for each product the one that its vendor and address keep: of highest authority,
    most variants, most complete, latest, last id. products: product_id, vendor_id, url, method, completeness, collected_at."""
    n = variants.groupBy("product_id").agg(F.count("*").alias("__variants"))
    rank = F.struct(authority(F.col("method")), F.coalesce(F.col("__variants"), F.lit(0)), "completeness", F.coalesce("collected_at", F.lit("")), "product_id")
    rows = products.join(n, "product_id", "left")
    best = rows.groupBy("vendor_id", "url").agg(F.max_by("product_id", rank).alias("kept_id"), F.count("*").alias("candidates"))
    return products.select("product_id", "vendor_id", "url").join(best, ["vendor_id", "url"]).select("product_id", "kept_id", "candidates")


def united(variants: DataFrame, chosen: DataFrame, completeness: Column, tie: Column) -> DataFrame:
    """All variants under the product that is kept, with what became of each: kept, or lost to which variant and by which
    step: the same variant_id, then the same weight to 4 places. Products that share their address with no other keep all
    theirs. variants: product_id, variant_id, grams, source_variant_id, collected_at; rank: most fields, a source id, the
    latest, the last variant_id, and of equals the first product, then the least tie."""
    rows = variants.join(chosen, "product_id").withColumnsRenamed({"product_id": "source_product_id"}).withColumn("product_id", F.col("kept_id"))
    rank = [completeness.desc(), F.coalesce(F.col("source_variant_id") != "", F.lit(False)).desc(), F.coalesce("collected_at", F.lit("")).desc(), F.desc("variant_id")]
    several = F.col("candidates") > 1
    by_id = Window.partitionBy("product_id", "variant_id").orderBy(*rank, F.asc("source_product_id"), tie)
    rows = rows.withColumn("lost_by", F.when(several & (F.row_number().over(by_id) > 1), F.lit("variant_id")))
    weight = F.when(several, F.format_string("%.4f", "grams")).otherwise(F.concat(F.lit("own "), F.col("source_product_id"), F.lit(" "), F.col("variant_id")))
    by_weight = Window.partitionBy("product_id", weight).orderBy(F.col("lost_by").isNotNull().asc(), *rank, F.asc("source_product_id"), tie)
    rows = rows.withColumn("__place", F.row_number().over(by_weight)).withColumn("kept_variant_id", F.first("variant_id").over(by_weight))
    lost = F.coalesce("lost_by", F.when(several & (F.col("__place") > 1), F.lit("weight")))
    return rows.withColumn("lost_by", lost).drop("__place", "kept_id")


def resolved(products: DataFrame, variants: DataFrame, completeness: Column, tie: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products kept, their variants in order of weight, price and id, the variants that lost)."""
    chosen = selected(products, variants)
    rows = united(variants, chosen, completeness, tie)
    kept = products.join(chosen.where("product_id = kept_id").select("product_id", "candidates"), "product_id")
    return kept, rows.where("lost_by IS NULL"), rows.where("lost_by IS NOT NULL")
