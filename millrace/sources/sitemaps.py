"""Products that a host's sitemaps lead to, as a frontier that grows by what is new.

Each round joins only the sitemaps that the round before found with all files by address, and takes from the locations of the
files that it meets the sitemaps and products that no earlier round had; other files are not taken apart. A host reads at most
MOST_DOCUMENTS sitemaps, in order of the document and place where each is first named, so there are at most as many rounds; a
sitemap that is not among the files counts too. Of its products the first MOST_PRODUCTS are kept in that order. These limits are
part of what is asked for.

A location counts if it is an https address of the host itself. Null files, files without locations and hosts without a root
give nothing. Several files of one address: their locations count together. Repeated locations count where they come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.addresses import joined, part
from millrace.functions.text import column
from millrace.sources.tables import settled

MOST_DOCUMENTS, MOST_PRODUCTS = 8, 120
# What names a sitemap, a product, and a page that is none.
SITEMAP_PATH, PRODUCT_PATH = r"(?i)(?:sitemap|xmlsitemap)", r"(?i)/(?:products?|product-page)/"
OTHER_PATH = r"(?i)/(?:blog|pages?|category|collections?|account|cart|checkout|search|polic(?:y|ies)|wp-content|wp-admin|feed)(?:/|$)"


def locations(files: DataFrame, url: str, xml: Column | str, *others: str) -> DataFrame:
    """(url, place, target): all locations of sitemap files in order, as full addresses; other columns of the files before these."""
    rows = files.select(*others, F.col(url).alias("url"), F.posexplode(F.regexp_extract_all(column(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("place", "loc"))
    return rows.select(*others, "url", "place", joined("url", "loc").alias("target")).where("target <> ''")


def _first(rows: DataFrame) -> DataFrame:
    """Each source's targets once, with the document and place that name them first."""
    return rows.groupBy("source", "target").agg(F.min(F.struct("document", "place")).alias("f")).select("source", "target", "f.*")


def sitemap_products(roots: DataFrame, files: DataFrame, url: str, xml: Column | str, product: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, place, target) of the products, and (source, document, target) of the sitemaps in the order of their reading.

    roots: source, url. xml: a column of the files, or an expression over them, worked out for files that a frontier reaches.
    product: what else a product's address (column target) must meet.
    """
    own = F.lower(part("target", 2)) == F.lower(part("root", 2))
    held = files.withColumn("__url", F.col(url))
    frontier = settled(roots.select("source", F.col("url").alias("target"), F.col("url").alias("root"), F.lit(1).alias("document")), "frontier")
    read, products = frontier, None
    while True:
        reached = frontier.select(*(F.col(c).alias(f"__{c}") for c in ("source", "root", "document")), F.col("target").alias("__url")).join(held, "__url")
        named = locations(reached, "__url", xml, "__source", "__root", "__document").withColumnsRenamed({f"__{c}": c for c in ("source", "root", "document")})
        named = settled(named.where((F.lower(part("target", 1)) == "https") & own), "locations")
        path = part("target", 3)
        kept = path.rlike(PRODUCT_PATH) & ~path.rlike(OTHER_PATH)
        new = named.where(kept if product is None else kept & product).select("source", "target", "document", "place")
        products = _first(new if products is None else products.unionByName(new))
        children = _first(named.where(path.rlike(SITEMAP_PATH)).select("source", "target", "document", "place")).join(read.select("source", "target"), ["source", "target"], "left_anti")
        so_far = read.groupBy("source").agg(F.max("document").alias("last"), F.first("root").alias("root"))
        place = F.row_number().over(Window.partitionBy("source").orderBy("document", "place"))
        frontier = children.withColumn("n", place).where(F.col("n") < MOST_DOCUMENTS).join(so_far, "source")
        frontier = frontier.select("source", "target", "root", (F.col("last") + F.col("n")).alias("document")).where(F.col("document") <= MOST_DOCUMENTS)
        frontier = settled(frontier, "frontier")
        products = settled(products, "products")
        if frontier.isEmpty():
            break
        read = read.unionByName(frontier)
    w = Window.partitionBy("source").orderBy("document", "place")
    ranked = products.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MOST_PRODUCTS)
    return ranked.select("source", F.col("n").alias("place"), "target"), read.select("source", "document", "target")
