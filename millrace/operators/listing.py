"""What listing pages say about products: scored links, windows of text around them, routes, fallbacks, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.addresses import joined, product_address
from millrace.functions.positions import cut, spots
from millrace.functions.text import column, decoded, plain_text, without_tags

#: Labels that name no product.
EMPTY_LABELS = ["options", "view product", "learn more", "shop now", "add to cart"]
#: How a link's label counts.
EVIDENCE_POINTS, NAMED_POINTS, PRICE_POINTS, MOST_CHARACTERS, MOST_LINKS = 100.0, 30.0, 10.0, 80, 120


def scored_links(links: DataFrame, key: str, evident: Column, generic: Column, price: Column | None = None) -> DataFrame:
    """Of each page (key, target, label, place) the best label of each target, with its score; the first MOST_LINKS by score."""
    label = F.col("label")
    score = F.when(evident, EVIDENCE_POINTS).otherwise(0.0) + F.when(~generic, NAMED_POINTS).otherwise(0.0) + F.least(F.length(label), F.lit(MOST_CHARACTERS)) / 100.0
    if price is not None:
        score = score + F.when(price.isNotNull(), PRICE_POINTS).otherwise(0.0)
    rows = links.where((F.length(label) >= 4) & ~F.lower(label).isin(EMPTY_LABELS)).withColumn("score", score)
    best = rows.groupBy(key, "target").agg(F.max_by(F.struct("label", "place", "score"), F.struct("score", -F.col("place"))).alias("b")).select(key, "target", "b.*")
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("place"))
    return best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MOST_LINKS)


def more_links(found: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Links found, and those of the others whose target was not, at most MOST_LINKS of these a page."""
    new = others.join(found.select(key, "target"), [key, "target"], "left_anti")
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("place"))
    return found.unionByName(new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MOST_LINKS).select(found.columns))


def windows(pages: DataFrame, key: str, url: str, html: str, marker: str, before: int = 900, after: int = 3200, beyond: int = 700) -> DataFrame:
    """(key, place, target, window): the page's text around each link to a product, from `before` characters ahead of it to
    `after` behind it, and no further than `beyond` into the next one."""
    rows = pages.select(key, url, column(html).alias("__h")).withColumn("__spots", spots(F.col("__h"), marker))

    def window(s: Column, i: Column) -> Column:
        following = F.get("__spots", i + 1)["start"]
        last = F.least(s["end"] + after, F.coalesce(following + beyond, F.lit(1 << 30)))
        return F.struct(cut(F.col("__h"), s["start"], s["end"]).alias("match"), cut(F.col("__h"), s["start"] - before, last).alias("window"))

    rows = rows.select(key, url, F.transform("__spots", window).alias("__cut")).select(key, url, F.posexplode("__cut").alias("place", "w"))
    target = product_address(joined(url, F.regexp_extract("w.match", marker, 1)))
    return rows.select(key, "place", target.alias("target"), "w.window")


def first_filled(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Of each key the first value of each field that is there."""
    return rows.groupBy(*keys).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def detail_or_fallback(structured: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Structured rows, and the fallback's for pages that have none."""
    return structured.unionByName(fallback.join(structured.select(key).distinct(), key, "left_anti").select(structured.columns))


def scanned(structured: DataFrame, links: DataFrame, details: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows of a listing and of the detail pages of links that it does not cover, (source, uncovered, read, failed, coverage)).
    details: source, url, ok, reason and the columns of structured."""
    open_links = links.select(source, "url").distinct().join(structured.select(source, F.regexp_replace("url", r"\?.*$", "").alias("url")), [source, "url"], "left_anti")
    read = open_links.join(details, [source, "url"], "left")
    rows = structured.unionByName(read.where("ok").select(structured.columns))
    report = read.groupBy(source).agg(F.count("*").alias("uncovered"), F.count_if("ok").alias("read"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("failed"))
    return rows, report.withColumn("coverage", F.when(F.col("failed") > 0, "partial").otherwise("complete"))


def first_route(rows: DataFrame, source: str, route: str) -> DataFrame:
    """Of each source the rows of its first route that has any."""
    first = rows.groupBy(source).agg(F.min(route).alias("__first"))
    return rows.join(first, source).where(F.col(route) == F.col("__first")).drop("__first")


def admitted(df: DataFrame, excluded: str, wanted: str, proof: str, ambiguous: str, context: str, explicit: str) -> DataFrame:
    """Rows (name, description, url, route_url) that are a product of the kind wanted: not excluded, wanted, proved by text or
    route, and where the form is in doubt, named so in the title."""
    text = F.concat_ws(" ", plain_text(without_tags(decoded("name"))), plain_text(without_tags(decoded("description"))))
    rows = df.withColumn("__t", text)
    t, unclear = F.col("__t"), F.col("__t").rlike(ambiguous) & F.col("__t").rlike(context)
    ok = (F.trim(column("name")) != "") & (F.trim(column("url")) != "") & ~t.rlike(excluded) & t.rlike(wanted) & (t.rlike(proof) | F.lower(column("route_url")).contains("thca"))
    return rows.where(ok & ~(unclear & ~column("name").rlike(explicit))).drop("__t")


# Answers that are worth another attempt, and kinds of failure with whether they are.
RETRYABLE_STATUS = [202, 408, 425, 429]
FAILURES = {
    "SSLCertVerificationError": ("tls_certificate_error", False), "TimeoutError": ("transport_timeout", True), "EAI_AGAIN": ("temporary_dns_failure", True), "gaierror": ("dns_failure", False), "SSLEOFError": ("tls_transport_failure", True),
    "SSLZeroReturnError": ("tls_transport_failure", True), "ConnectionError": ("connection_failure", True), "OSError": ("transport_os_error", True), "URLError": ("url_error", False),
}


def retryable(status: Column) -> Column:
    s = status.try_cast("int")
    return F.coalesce(s.isin(RETRYABLE_STATUS) | s.between(500, 599), F.lit(False))


def failure(name: Column) -> Column:
    """struct(category, retryable) of a failure by its class."""
    table = F.create_map(*(x for k, (c, r) in FAILURES.items() for x in (F.lit(k), F.struct(F.lit(c).alias("category"), F.lit(r).alias("retryable")))))
    return F.coalesce(F.try_element_at(table, name), F.struct(F.lit("processing_error").alias("category"), F.lit(False).alias("retryable")))


def authoritative(df: DataFrame) -> Column:
    """Rows that a shop's own feed made, with evidence of their type."""
    primary = column("primary_type")
    return column("source_type").isin("shopify", "woo") & (column("evidence_source") == "storefront_record") & (primary != "") & (column("evidence_type") == primary) & F.coalesce(F.array_contains("type_tags", primary), F.lit(False))
