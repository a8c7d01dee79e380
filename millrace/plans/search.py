"""Faceted search over products and their best variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import natural_key, search_text, with_search_text
from millrace.operators.offers import SORTS, Request, choose, order, page, search
from millrace.operators.segments import offsets
from millrace.plans.registry import query
from millrace.plans.shapes import PRODUCTS, VARIANTS, products, variants
from millrace.sources.tables import table

_CHOSEN = """chosen AS (SELECT product_id, variant_id, grams, price, unit_price, sizes FROM (
 SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY unit_price, price, grams, variant_id) AS n,
 count(*) OVER (PARTITION BY product_id) AS sizes FROM variants WHERE {grams}) WHERE n = 1)"""
_HEAD = "WITH " + PRODUCTS + ", " + VARIANTS + ", "


def _placed(df: DataFrame, request: Request) -> DataFrame:
    """A page with each row's place, as results are compared without order."""
    w = Window.orderBy(*order(request))  # over one page
    return df.withColumn("place", F.row_number().over(w) + request.offset)


@query(_HEAD + _CHOSEN.format(grams="grams BETWEEN 5 AND 40") + """
SELECT product_id, name, vendor, category, potency, variant_id, grams, price, unit_price, sizes, place FROM (
 SELECT p.product_id, name, vendor, category, potency, variant_id, grams, price, unit_price, sizes,
 CAST(row_number() OVER (ORDER BY unit_price, product_id, variant_id) AS INTEGER) AS place FROM products p JOIN chosen USING (product_id)
 WHERE contains(search_text, 'widget') AND category IN ('small', 'large', 'promo') AND potency BETWEEN 3 AND 45 AND price BETWEEN 100 AND 60000)
WHERE place BETWEEN 11 AND 50""")
def best_offer_page(spark: SparkSession, folder: str) -> DataFrame:
    r = Request(text="widget", categories=("small", "large", "promo"), grams=(5, 40), potency=(3, 45), price=(100, 60000), offset=10, limit=40)
    return _placed(page(search(products(spark, folder), variants(spark, folder), r), r).drop("search_text"), r)


@query("WITH " + VARIANTS + ", " + _CHOSEN.format(grams="true") + """
SELECT product_id, variant_id, grams, price, unit_price, sizes FROM chosen WHERE price <= 20000 AND unit_price >= 500""")
def offer_price_after_choice(spark: SparkSession, folder: str) -> DataFrame:
    return choose(variants(spark, folder), Request(price=(None, 20000), unit_price=(500, None)))


@query("WITH " + VARIANTS + """ SELECT product_id, count(*) AS sizes, count(DISTINCT grams) AS weights, min(unit_price) AS least FROM variants GROUP BY product_id""")
def available_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return variants(spark, folder).groupBy("product_id").agg(F.count("*").alias("sizes"), F.count_distinct("grams").alias("weights"), F.min("unit_price").alias("least"))


def _sort_sql() -> str:
    parts = []
    for name, (col, down, text) in SORTS.items():
        key = f"lower({col})" if text else col
        if text:
            key = f"regexp_replace(lower({col}), '(\\d+)', 'x', 'g') || lpad(regexp_extract({col}, '(\\d+)', 1), 20, '0')"
            key = f"(CASE WHEN {col} LIKE 'Brand#%' THEN 'brand#' || lpad(regexp_extract({col}, '(\\d+)', 1), 20, '0') ELSE lower({col}) END)"
        nulls = "DESC NULLS FIRST" if down else "ASC NULLS LAST"
        parts.append(f"SELECT '{name}' AS sort, product_id, CAST(row_number() OVER (ORDER BY {key} {nulls}, product_id, variant_id) AS INTEGER) AS place FROM m")
    return "WITH " + PRODUCTS + ", " + VARIANTS + ", " + _CHOSEN.format(grams="true") + ", m AS (SELECT * FROM products JOIN chosen USING (product_id)) SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE place <= 20"


@query(_sort_sql())
def all_sorts(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty of each of the ten sorts (a top-k report). All sorts ask for the same matches, so Spark runs the
    search's shuffles once and reuses them."""
    matches, out = search(products(spark, folder), variants(spark, folder), Request()), None
    for name in SORTS:
        r = Request(sort=name, limit=20)
        part = _placed(page(matches, r), r).select(F.lit(name).alias("sort"), "product_id", "place")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer)
SELECT * FROM (SELECT 'falling' AS sort, c_custkey, balance, CAST(row_number() OVER (ORDER BY coalesce(balance, 'infinity'::DOUBLE) DESC, c_custkey) AS INTEGER) AS place FROM t
UNION ALL SELECT 'rising', c_custkey, balance, CAST(row_number() OVER (ORDER BY coalesce(balance, 'infinity'::DOUBLE), c_custkey) AS INTEGER) FROM t) WHERE place <= 300""")
def null_order(spark: SparkSession, folder: str) -> DataFrame:
    """Missing numbers count as infinite: last when rising, first when falling (a report of the first 300 of both)."""
    t = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"))
    out = None
    for name, key in (("falling", F.col("balance").desc_nulls_first()), ("rising", F.col("balance").asc_nulls_last())):
        part = t.orderBy(key, "c_custkey").limit(300).select(F.lit(name).alias("sort"), "c_custkey", "balance", F.row_number().over(Window.orderBy(key, "c_custkey")).alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT s_suppkey, 'supplier#' || lpad(regexp_extract(s_name, '([0-9]+)', 1), 20, '0') AS by_name, 'vendor ' || lpad(CAST(s_suppkey % 23 AS VARCHAR), 20, '0') AS by_label FROM supplier""")
def natural_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Sort keys with numbers by value and without regard to case: "Vendor 2" before "VENDOR 10"."""
    s = table(spark, folder, "supplier")
    n = F.col("s_suppkey") % 23
    label = F.concat(F.when(n % 2 == 0, F.lit("Vendor ")).otherwise(F.lit("VENDOR ")), n.cast("string"))
    return s.select("s_suppkey", F.lower(natural_key("s_name", None)).alias("by_name"), F.lower(natural_key(label, None)).alias("by_label"))


@query("""WITH t AS (SELECT count(*) AS total FROM part) SELECT total, CAST(o AS BIGINT) AS start, CASE WHEN o + 120 < total THEN CAST(o + 120 AS BIGINT) END AS next_offset,
 (SELECT count(*) FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 120 OFFSET o)) AS rows FROM t, (VALUES (0), (120), (240)) v(o)""".replace("(SELECT count(*) FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 120 OFFSET o))", "greatest(0, least(120, total - o))"))
def page_slices(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey")
    out = None
    for start in (0, 120, 240):
        part = p.orderBy("p_partkey").offset(start).limit(120).agg(F.count("*").alias("rows")).withColumn("start", F.lit(start).cast("long"))
        out = part if out is None else out.unionByName(part)
    total = p.agg(F.count("*").alias("total"))
    following = F.when(F.col("start") + 120 < F.col("total"), F.col("start") + 120)
    return out.crossJoin(F.broadcast(total)).select("total", "start", following.alias("next_offset"), "rows")  # three rows and one


@query("""SELECT l_orderkey, variant_id, CAST(coalesce(sum(h) OVER (PARTITION BY l_orderkey ORDER BY variant_id, l_partkey, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS height_before
FROM (SELECT l_orderkey, l_partkey, l_linenumber || '-' || l_suppkey AS variant_id, CAST(l_quantity AS BIGINT) AS h FROM lineitem)""")
def prefix_offsets(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.concat_ws("-", "l_linenumber", "l_suppkey").alias("variant_id"), F.col("l_quantity").cast("long").alias("h"))
    return offsets(i, ["l_orderkey"], [F.col("variant_id"), F.col("l_partkey"), F.col("h")], F.col("h"), "height_before").select("l_orderkey", "variant_id", "height_before")


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[\p{P}\p{S}\s]+', ' ', 'g')) AS key FROM part WHERE contains(trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[\p{P}\p{S}\s]+', ' ', 'g')), 'brand 1')""")
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", search_text(F.concat_ws(" / ", "p_brand", "p_name")).alias("key"))
    return p.where(F.col("key").contains("brand 1"))


@query(r"""SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[\p{P}\p{S}\s]+', ' ', 'g')) AS key FROM documents""")
def document_search_text(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts folded for search: accents and case gone, punctuation and symbols as blanks."""
    return with_search_text(table(spark, folder, "documents").select("doc_id", "text"), "text", "key").drop("text")
