"""The driver's tables in the shapes of a catalogue: parts are products, line items their variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import search_text
from millrace.sources.tables import table


def products(spark: SparkSession, folder: str) -> DataFrame:
    """(product_id, name, vendor, category, potency, search_text)."""
    p = table(spark, folder, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("vendor"), F.lower("p_type").alias("category"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).alias("potency"), search_text(F.concat_ws("\n", "p_brand", "p_name")).alias("search_text"),
    )


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """(product_id, variant_id, grams, price, unit_price); variant_id names all of a line item's columns that count, as
    line numbers repeat."""
    i = table(spark, folder, "lineitem")
    unit = F.round(F.col("l_extendedprice").cast("decimal(18,2)") / F.col("l_quantity").cast("decimal(18,2)"), 4).cast("double")
    identity = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey")
    return i.select(F.col("l_partkey").alias("product_id"), identity.alias("variant_id"), F.col("l_quantity").alias("grams"), F.col("l_extendedprice").alias("price"), unit.alias("unit_price"))


#: The same in SQL, for the oracles.
PRODUCTS = r"""products AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS vendor, lower(p_type) AS category,
 CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS potency,
 trim(regexp_replace(lower(p_brand || chr(10) || p_name), '[\p{P}\p{S}\s]+', ' ', 'g')) AS search_text FROM part)"""
VARIANTS = """variants AS (SELECT l_partkey AS product_id, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS variant_id,
 l_quantity AS grams, l_extendedprice AS price,
 CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) * 100 + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS DOUBLE) / 10000 AS unit_price FROM lineitem)"""
