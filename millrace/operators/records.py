"""Nested records: products with variants from JSON, prices in minor units, bounded and public views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import column

#: What a shop's product feed holds.
FEED = "products array<struct<id:string,title:string,handle:string,variants:array<struct<id:string,title:string,price:string,available:boolean>>>>"
#: Texts that stand for nothing.
PLACEHOLDERS = ["", "unknown", "unavailable", "n/a", "none", "-", "—"]


def feed_rows(feeds: DataFrame, key: str, payload: str) -> DataFrame:
    """One row a variant; its title joins the product's unless it is the default one. Broken feeds give no rows."""
    parsed = feeds.select(key, F.from_json(payload, FEED).alias("f"))
    products = parsed.select(key, F.explode("f.products").alias("p"))
    rows = products.select(key, "p.id", "p.title", "p.handle", F.explode_outer("p.variants").alias("v"))
    named = F.when(F.coalesce(F.lower("v.title"), F.lit("default title")) == "default title", F.col("title")).otherwise(F.concat_ws(" - ", "title", "v.title"))
    return rows.select(key, F.col("id").alias("product_id"), F.col("v.id").alias("variant_id"), named.alias("name"), F.col("v.price").try_cast("double").alias("price"), F.coalesce("v.available", F.lit(False)).alias("available"))


def minor_units(amount: Column, digits: Column) -> Column:
    """A price given in the currency's smallest unit."""
    return (amount.try_cast("decimal(18,6)") / F.pow(F.lit(10), digits).cast("decimal(18,0)")).cast("double")


def repaired_price(text: Column, marked: Column) -> Column:
    """A whole number of 1000 or more, where cents are marked, is in cents."""
    value = text.try_cast("double")
    return F.when(marked & ~text.contains(".") & (value >= 1000), value / 100).otherwise(value)


def there(c: Column | str) -> Column:
    """Neither null, nor empty, nor a placeholder."""
    return ~F.lower(F.trim(column(c))).isin(PLACEHOLDERS)


def missing_score(*fields: Column | str) -> Column:
    return sum((~there(f)).cast("int") for f in fields)


def hidden(df: DataFrame, when: Column, fields: list[str]) -> DataFrame:
    """The public view: these fields are empty in rows where the condition holds."""
    return df.withColumns({f: F.when(when, F.lit("")).otherwise(F.col(f)) for f in fields})


def first_per_key(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """A report of the first rows of each key; Spark keeps `most` a key before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def routed(structured: Column, evident: Column, detail: Column) -> Column:
    """What becomes of a candidate: kept at once, kept or rejected by its detail page, or failed without one."""
    return F.when(structured | evident, F.lit("kept")).when(detail.isNull(), F.lit("failure")).when(detail, F.lit("kept_by_detail")).otherwise(F.lit("rejected"))
