"""Facts from HTML: structured data blocks, meta tags, links, titles, sitemaps. Built-in functions only, but for the walk
through structured data."""

from __future__ import annotations

import html as html_module
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.addresses import host, joined, product_address
from millrace.functions.paths import parsed
from millrace.functions.text import clean_text, column, plain_text, strip_tags, without_tags
from millrace.operators.ranking import best_row

#: The keys under which structured data nests products and offers.
NESTED = ("@graph", "itemListElement", "mainEntity", "item", "offers", "hasVariant")


def title(html: Column | str) -> Column:
    return clean_text(F.regexp_extract(column(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def first_heading(html: Column | str) -> Column:
    return strip_tags(F.regexp_extract(column(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def metas(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, name, content): the first content of each meta name or property, in lower case."""
    tags = pages.select(key, F.posexplode(F.regexp_extract_all(column(html), F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))).alias("place", "tag"))
    name = F.lower(F.regexp_extract("tag", r"(?i)\b(?:property|name)\s*=\s*[\"']([^\"']+)", 1))
    content = F.regexp_extract("tag", r"(?is)\bcontent\s*=\s*[\"']([^\"']*)", 1)
    rows = tags.select(key, "place", name.alias("name"), clean_text(content).alias("content")).where("name <> ''")
    return rows.groupBy(key, "name").agg(F.min_by("content", "place").alias("content"))


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, place, target, label): anchors in order, as canonical addresses; each target once, where it comes first."""
    anchors = F.regexp_extract_all(column(html), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    rows = pages.select(key, url, F.posexplode(anchors).alias("place", "a"))
    href = F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']*)", 1)
    # Step by step: an address's parts are taken from one column, which is computed once.
    rows = rows.select(key, "place", "a", joined(url, href).alias("link")).where("link <> ''")
    rows = rows.select(key, "place", "a", product_address("link").alias("target")).where("target <> ''")
    rows = rows.select(key, "place", "target", plain_text(without_tags("a")).alias("label"))
    best = rows.groupBy(key, "target").agg(F.min(F.struct("place", "label")).alias("f"))
    return best.select(key, "f.place", "target", "f.label")


def product_links(found: DataFrame, pages: DataFrame, key: str, url: str, markers: str, most: int) -> DataFrame:
    """Links to the page's own host with a marker in their path, the first `most` of each page."""
    own = found.join(pages.select(key, host(url).alias("own_host")), key).where((host("target") == F.col("own_host")) & F.col("target").rlike(markers))
    w = Window.partitionBy(key).orderBy("place")
    return own.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n", "own_host")


def sitemap_urls(files: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, place, target): the locations of a sitemap, each once."""
    rows = files.select(key, F.posexplode(F.regexp_extract_all(column(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("place", "loc"))
    return rows.select(key, "place", product_address(clean_text("loc")).alias("target")).where("target <> ''").groupBy(key, "target").agg(F.min("place").alias("place"))


def walk(data: object) -> Iterator[dict]:
    """All objects of structured data, the outer before the inner, through the keys of NESTED, at any depth."""
    waiting = [data]
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting += reversed(node)
        elif isinstance(node, dict):
            yield node
            waiting += [node[k] for k in reversed(NESTED) if isinstance(node.get(k), (dict, list))]


def kinds(node: dict) -> set[str]:
    """The types of an object, in lower case."""
    own = node.get("@type")
    return {str(x).lower() for x in (own if isinstance(own, list) else [own])}


def _offers(product: dict, any_nested: bool) -> Iterator[dict]:
    """A product's offers in order; an aggregate (or, if any_nested, any offer) that holds offers stands for these."""
    waiting = [product.get("offers")]
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting += reversed(node)
        elif isinstance(node, dict):
            inner = node.get("offers")
            if inner and isinstance(inner, (dict, list)) and (any_nested or "aggregateoffer" in kinds(node)):
                waiting.append(inner)
            else:
                yield node


PRICES = ("price", "lowPrice", "highPrice")
OFFER = pa.struct([(n, pa.string()) for n in ("name", "price", "low_price", "high_price", "availability", "url", "size")])


def _products(block: str, any_nested: bool) -> Iterator[dict]:
    said = lambda x: None if x is None else str(x)
    for node in walk(parsed(html_module.unescape(block.strip()))):
        if "product" in kinds(node):
            for o in list(_offers(node, any_nested)) or [{}]:
                yield {
                    "name": str(node.get("name") or ""), "price": said(next((o[k] for k in PRICES if o.get(k) not in (None, "")), None)), "low_price": said(o.get("lowPrice")), "high_price": said(o.get("highPrice")),
                    "availability": str(o.get("availability") or "").rsplit("/", 1)[-1], "url": str(o.get("url") or node.get("url") or ""), "size": str(o.get("name") or o.get("size") or o.get("sku") or ""),
                }


def structured_offers(pages: DataFrame, key: str, html: str, any_nested: bool = True) -> DataFrame:
    """(key, place, name, price, low_price, high_price, availability, url, size): the offers of Product objects in ld+json
    blocks, in order; a product without any gives one row. price is the first given of an offer's price, low and high price.
    An offer that holds offers stands for these, if any_nested, or only if it is an AggregateOffer. Types in any case,
    entities in blocks decoded, graphs of any depth. Broken blocks: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[o for block in blocks or [] for o in _products(block, any_nested)] for blocks in batch.column("blocks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(OFFER))], names=[key, "offers"])

    blocks = F.regexp_extract_all(column(html), F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    rows = pages.select(key, blocks.alias("blocks")).where(F.size("blocks") > 0)
    fields = ",".join(f"{f.name}:string" for f in OFFER)
    found = rows.mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, offers array<struct<{fields}>>")
    return found.select(key, F.posexplode("offers").alias("place", "o")).select(key, "place", "o.*")


def structured_products(pages: DataFrame, key: str, html: str, any_nested: bool = True) -> DataFrame:
    """As structured_offers, with one price."""
    return structured_offers(pages, key, html, any_nested).drop("low_price", "high_price")


def per_weight(offers: DataFrame, key: str, grams: Column) -> DataFrame:
    """Of a page's offers with a price one a package weight, the first by size text and address."""
    rows = offers.where("price IS NOT NULL").withColumn("grams", grams).where("grams IS NOT NULL")
    return best_row(rows, [key, "grams"], [F.asc("size"), F.asc("url"), F.asc("place")])
