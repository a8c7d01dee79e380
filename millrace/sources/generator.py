"""Deterministic catalogues for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The package sizes of a generated product.
SIZES = (1.0, 3.5, 7.0, 14.0, 28.0, 56.0)


def offers(spark: SparkSession, products: int, variants: int = 4, vendors: int = 25, seed: int = 7) -> DataFrame:
    """products x variants rows; every value is a function of its row's numbers."""
    rows = spark.range(products * variants).select((F.col("id") / variants).cast("long").alias("p"), (F.col("id") % variants).cast("int").alias("v"))
    noise = F.pmod(F.xxhash64("p", "v", F.lit(seed)), F.lit(1000)) / 1000
    grams = F.element_at(F.array(*map(F.lit, SIZES)), (F.col("v") % len(SIZES)) + 1)
    price = F.round(grams * (4 + 6 * noise), 2)
    return rows.select(
        F.format_string("p-%06d", "p").alias("product_id"), F.format_string("p-%06d-%d", "p", "v").alias("variant_id"), F.format_string("vendor %d", F.col("p") % vendors).alias("vendor"),
        F.format_string("Product %d", "p").alias("name"), grams.alias("grams"), price.alias("price"), F.round(price / grams, 4).alias("unit_price"), (F.col("p") % 7 != 0).alias("in_stock"),
    )
