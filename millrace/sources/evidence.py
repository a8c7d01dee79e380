"""What a product's own page says it is, and the documents that it links to.

Null pages: as empty. Broken blocks of structured data say nothing. Other columns than those named are not read.
"""

from __future__ import annotations

import html as html_module

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.addresses import joined, part
from millrace.functions.paths import parsed
from millrace.functions.positions import let
from millrace.functions.text import collapse, column, decoded, without_tags
from millrace.sources.pages import kinds, walk

# Metas and product fields that are evidence, and words that show the kind of product.
METAS = ("og:title", "twitter:title", "og:description", "twitter:description", "description", "product:category")
FACTS = ("name", "description", "category", "sku", "productID")
FLOWER, THCA = r"(?i)\b(thca\s+flower|hemp\s+flower|flower|buds?|smalls|shake)\b", r"(?i)\b(thca|thc-a|high\s+thca|type\s+[i1])\b"
WINDOW = r"(?is).{0,700}\b(?:thc-?a|high\s+thca)\b.{0,1000}"
MOST_WINDOWS = 12
# Words and paths of documents, and labels that name none in particular.
DOCUMENT = r"(?i)\b(?:coa|certificate\s+of\s+analysis|download\s+(?:the\s+)?coa|view\s+(?:the\s+)?coa|lab\s+(?:report|results?)|full\s+panel|test\s+results?)\b"
DOCUMENT_PATH = r"(?i)(?:coa|certificate|lab[-_ ]?(?:report|result)|full[-_ ]?panel|test[-_ ]?result)"
GENERIC = ("lab results", "lab reports", "test results")
MOST_DOCUMENTS = 12


@F.pandas_udf(T.StringType())
def _facts(blocks: pd.Series) -> pd.Series:
    """The fields of FACTS of all products in a page's blocks, joined by blanks."""

    def said(own) -> str:
        products = (node for block in own for node in walk(parsed(html_module.unescape(block.strip()))) if "product" in kinds(node))
        return " ".join(str(p[f]) for p in products for f in FACTS if p.get(f))

    return blocks.map(said, na_action="ignore")


def shown_text(html: Column) -> Column:
    """The text that a page shows: without scripts, styles and markup, references decoded."""
    return decoded(without_tags(F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", " ")))


def path_text(url: Column | str) -> Column:
    path = part(url, 3)
    return F.translate(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), "-_", "  ")


def page_evidence(pages: DataFrame, url: str, html: str, excluded: str) -> DataFrame:
    """Adds evidence, explicit_thca, explicit_flower and evidence_sha256 (of the evidence in lower case).

    Evidence is what metas, the title, structured data and the path say. If that does not show both kinds of words, or shows an
    excluded one, the first MOST_WINDOWS windows of the page's own text around the first kind are added. A page is read whole.
    """
    tags = F.regexp_extract_all(column(html), F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    metas = F.transform(tags, lambda t: F.struct(F.lower(F.regexp_extract(t, r"(?i)\b(?:property|name)\s*=\s*[\"']([^\"']+)", 1)).alias("n"), F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1).alias("c")))
    blocks = F.regexp_extract_all(column(html), F.lit(r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    rows = pages.withColumns({"__metas": metas, "__blocks": blocks, "__title": F.regexp_extract(column(html), r"(?is)<title\b[^>]*>(.*?)</title>", 1)})
    first = lambda name: F.get(F.filter("__metas", lambda m: m["n"] == F.lit(name)), F.lit(0))["c"]
    rows = rows.withColumn("__facts", F.when(F.size("__blocks") > 0, _facts(F.when(F.size("__blocks") > 0, F.col("__blocks")))))
    parts = F.filter(F.array(*(first(n) for n in METAS), F.col("__title"), F.col("__facts"), path_text(url)), lambda x: F.coalesce(x != "", F.lit(False)))
    rows = rows.withColumn("__own", collapse(without_tags(decoded(F.array_join(parts, " ")))))
    shows = lambda t: t.rlike(THCA) & t.rlike(FLOWER) & ~t.rlike(excluded)
    windows = F.slice(F.regexp_extract_all(shown_text(column(html)), F.lit(WINDOW), F.lit(0)), 1, MOST_WINDOWS)
    more = let(windows, lambda w: F.when(F.size(w) > 0, collapse(without_tags(decoded(F.concat_ws(" ", "__own", F.array_join(w, " ")))))).otherwise(F.col("__own")))
    rows = rows.withColumn("evidence", F.when(shows(F.col("__own")), F.col("__own")).otherwise(more))
    found = {"explicit_thca": F.col("evidence").rlike(THCA), "explicit_flower": F.col("evidence").rlike(FLOWER), "evidence_sha256": F.sha2(F.lower("evidence"), 256)}
    return rows.withColumns(found).drop("__metas", "__blocks", "__title", "__facts", "__own")


def product_documents(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, place, target, kind, label, is_pdf): the first MOST_DOCUMENTS documents that a product's page links to, each address
    once, where it comes first. A link counts by its words or its path; a label that names none in particular only by its
    path, or if the product's own name stands in the address."""
    anchors = F.regexp_extract_all(column(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    handle = F.lower(F.element_at(F.split(F.rtrim(part(url, 3), F.lit("/")), "/"), -1))
    rows = pages.select(key, url, F.coalesce(F.try_url_decode(handle), handle).alias("handle"), F.posexplode(anchors).alias("at", "a"))
    head = F.regexp_extract("a", r"(?is)^<a\b([^>]*)>", 1)
    attribute = lambda n: decoded(F.regexp_extract("head", rf"(?i)(?<![:\w-]){n}\s*=\s*[\"']([^\"']*)[\"']", 1))
    rows = rows.withColumn("head", head).withColumns({"href": attribute("href"), "body": F.regexp_extract("a", r"(?is)^<a\b[^>]*>(.*?)</a>$", 1)})
    rows = rows.withColumns({"label": collapse(without_tags(decoded(F.concat_ws(" ", "body", attribute("title"), attribute("aria-label"))))), "link": joined(url, "href")}).where(F.lower(part("link", 1)).isin("http", "https"))
    path = part("link", 3)
    target = F.concat(F.lower(part("link", 1)), F.lit("://"), F.lower(part("link", 2)), F.when(path == "", "/").otherwise(path), F.when(part("link", 4) != "", F.concat(F.lit("?"), part("link", 4))).otherwise(""))
    rows = rows.withColumns({"target": target, "path": path, "signal": F.concat_ws(" ", "label", "href")})
    file = F.lower("path").endswith(".pdf") | F.col("path").rlike(DOCUMENT_PATH)
    unsure = F.lower("label").isin(*GENERIC) & ~file & (F.col("handle") != "") & ~F.contains(F.lower("target"), F.col("handle"))
    rows = rows.where((F.col("signal").rlike(DOCUMENT) | file) & ~unsure)
    kind = F.when(F.lower("signal").contains("terpene") & ~F.lower("signal").contains("coa"), "terpene").otherwise("coa")
    best = rows.withColumn("kind", kind).groupBy(key, "target").agg(F.min(F.struct("at", "kind", "label")).alias("f"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("f.at"))).where(F.col("place") <= MOST_DOCUMENTS)
    return ranked.select(key, "place", "target", "f.kind", "f.label", F.lower(part("target", 3)).endswith(".pdf").alias("is_pdf"))
