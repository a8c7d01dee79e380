"""Tables that are added to and reported from, and listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ledger, listing
from millrace.plans.registry import query
from millrace.sources.tables import table


@query("""WITH n AS (SELECT o_custkey % 300 AS key, CASE WHEN o_custkey % 300 < 200 OR o_orderkey % 50 = 0 THEN 'same' ELSE 'x' || (o_orderkey % 2) END AS content FROM orders), e AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'same' ELSE 'old' END AS content FROM customer WHERE c_custkey % 4 = 0),
 k AS (SELECT key, min(content) AS least, max(content) AS most FROM n GROUP BY key), j AS (SELECT k.*, e.content AS old FROM k LEFT JOIN e USING (key))
SELECT key, 'conflict' AS outcome FROM j WHERE least <> most OR old <> least UNION ALL SELECT key, 'inserted' FROM j WHERE least = most AND old IS NULL""")
def inserted_keys(spark: SparkSession, folder: str) -> DataFrame:
    """What of new rows is added, and what conflicts with a row that is there."""
    k = F.col("o_custkey") % 300
    new = table(spark, folder, "orders").select(k.alias("key"), F.when((k < 200) | (F.col("o_orderkey") % 50 == 0), "same").otherwise(F.concat(F.lit("x"), F.col("o_orderkey") % 2)).alias("content"))
    old = table(spark, folder, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "same").otherwise("old").alias("content"))
    fresh, conflicts = ledger.inserted(old, new, "key", "content")
    return fresh.select("key", F.lit("inserted").alias("outcome")).unionByName(conflicts.withColumn("outcome", F.lit("conflict")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'state' || (c_custkey % 3) ELSE c_mktsegment END AS state FROM customer UNION ALL SELECT -1, 'missing'""")
def updated_states(spark: SparkSession, folder: str) -> DataFrame:
    """A field changed by key; changes of unknown keys come out apart."""
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"))
    changes = c.where("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("state"), F.col("c_custkey") % 3).alias("state")).unionByName(spark.range(1).select((F.col("id") - 1).alias("c_custkey"), F.lit("x").alias("state")))
    out, missing = ledger.updated(c, changes, "c_custkey", "state")
    return out.unionByName(missing.select("c_custkey", F.lit("missing").alias("state")))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'old' ELSE 'new' END AS source_commit, s_suppkey % 4 = 0 AS refused FROM supplier""")
def stamped_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards stamped with a commit; another one's stamp is never changed."""
    k = F.col("s_suppkey") % 4
    out, refused = ledger.stamped(table(spark, folder, "supplier").select("s_suppkey", F.when(k == 0, "old").when(k == 1, "new").when(k == 2, "").alias("source_commit")), "new")
    return out.join(refused.select("s_suppkey", F.lit(True).alias("refused")), "s_suppkey", "left").select("s_suppkey", "source_commit", F.coalesce("refused", F.lit(False)).alias("refused"))


_LINES = "SELECT l_partkey AS product_id, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS variant_id, l_quantity AS grams, l_extendedprice AS current_price, l_extendedprice / l_quantity AS price_per_gram, l_suppkey % 5 <> 1 AS in_stock FROM lineitem"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "lineitem")
    return i.select(F.col("l_partkey").alias("product_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("variant_id"), F.col("l_quantity").alias("grams"), F.col("l_extendedprice").alias("current_price"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_gram"), (F.col("l_suppkey") % 5 != 1).alias("in_stock"))


@query(f"""WITH v AS ({_LINES}), n AS (SELECT product_id, string_agg(variant_id, ',' ORDER BY grams, current_price, variant_id, price_per_gram) AS variants FROM v GROUP BY product_id), b AS (SELECT product_id, variant_id FROM v WHERE in_stock QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price_per_gram, current_price, grams, variant_id) = 1)
SELECT p_partkey AS product_id, p_brand AS vendor, n.variants, b.variant_id AS default_variant_id FROM part LEFT JOIN n ON n.product_id = p_partkey LEFT JOIN b ON b.product_id = p_partkey""")
def index_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Products with their variants nested in order, and the default one."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("vendor"))
    rows = ledger.index_rows(p, _lines(spark, folder), ["vendor"])
    return rows.select("product_id", "vendor", F.array_join(F.transform("variants", lambda v: v["variant_id"]), ",").alias("variants"), "default_variant_id")


@query(f"""WITH v AS ({_LINES}) SELECT product_id, count(*) AS n, max(grams) AS grams FROM v WHERE in_stock AND grams > 40 GROUP BY product_id""")
def renderable_products(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"))
    rows = ledger.renderable(ledger.index_rows(p, _lines(spark, folder), []), lambda v: v["in_stock"] & (v["grams"] > 40))
    return rows.select("product_id", F.size("variants").cast("long").alias("n"), F.array_max(F.transform("variants", lambda v: v["grams"])).alias("grams"))


@query("""SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_mktsegment), lower(c_name), c_custkey) AS INTEGER) AS product_place, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, c_name, '', CAST(c_custkey % 7 AS VARCHAR), c_custkey) AS INTEGER) AS rejection_place FROM customer""")
def total_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Places in the orders of products and of rejections, within each nation."""
    c = table(spark, folder, "customer").select("c_nationkey", "c_custkey", F.upper("c_mktsegment").alias("vendor_name"), F.col("c_name").alias("strain_name"), F.col("c_custkey").alias("product_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("source_id"), F.col("c_name").alias("source_title"), F.lit(None).cast("string").alias("source_record_id"), (F.col("c_custkey") % 7).cast("string").alias("reason"))
    rows = ledger.ordered(c, ledger.product_order(), "product_place", ["c_nationkey"])
    return ledger.ordered(rows, [*ledger.rejection_order(), F.asc("c_custkey")], "rejection_place", ["c_nationkey"]).select("c_nationkey", "c_custkey", "product_place", "rejection_place")


@query("""WITH d AS (SELECT l_partkey AS p, l_orderkey AS d, l_suppkey % 3 = 0 AS ok FROM lineitem), j AS (SELECT DISTINCT p, o_orderkey AS doc, o_orderpriority AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'parsed' ELSE 'unparsed' END AS st FROM d JOIN orders ON o_orderkey = d WHERE ok AND o_custkey % 5 = p % 5)
SELECT p_partkey AS product_id, count(doc) AS documents, string_agg(doc || kind || st, ',' ORDER BY doc) AS held FROM part LEFT JOIN j ON p = p_partkey GROUP BY p_partkey""")
def annotated_products(spark: SparkSession, folder: str) -> DataFrame:
    """All products with the documents of their own vendor that were matched to them."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_partkey") % 5).alias("vendor_id"))
    i, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    decisions = i.select(F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_suppkey") % 3 == 0, "matched").otherwise("ambiguous").alias("status")).distinct()
    candidates = o.select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 5).alias("vendor_id"), F.col("o_orderpriority").alias("kind"))
    records = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("document_id"), F.lit("parsed").alias("parse_status"))
    rows = ledger.annotated(p, decisions, candidates, records)
    held = F.array_join(F.transform("documents", lambda d: F.concat(d["document_id"].cast("string"), d["kind"], d["parse_status"])), ",")
    return rows.select("product_id", F.size("documents").cast("long").alias("documents"), F.when(F.size("documents") > 0, held).alias("held"))


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || CASE WHEN n_nationkey % 4 = 0 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END || '}' AS value FROM nation""")
def json_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as JSON with keys in order of name."""
    n = table(spark, folder, "nation")
    return ledger.json_lines(n.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("n_regionkey")))


@query("""WITH f AS (SELECT 'p' || page_id AS path, sha256(html) AS h, octet_length(encode(html)) AS b FROM pages) SELECT count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes, sha256(string_agg(path || ':' || h, chr(10) ORDER BY path || ':' || h)) AS digest, (SELECT count(*) FROM part) AS products FROM f""")
def release_receipt(spark: SparkSession, folder: str) -> DataFrame:
    """One digest over all files' hashes, and the release's metrics."""
    files = table(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))
    metrics = table(spark, folder, "part").agg(F.count("*").alias("value")).select(F.lit("products").alias("name"), "value")
    return ledger.receipt(files, metrics).select("files", "bytes", "digest", F.col("metrics")["products"].alias("products"))


_LISTED = "concat('<ul><li><a class=\"c\" href=\"/products/', p_partkey, '\">Item ', p_partkey, '</a> 12% <b>', p_size, '</b></li>', repeat('x', p_size * 4), '<li><a href=\"/products/', p_partkey + 1, '\">Other</a> tail</li></ul>', repeat('y', 60))"
_MARKER = r'<a\s[^>]*href="(/products/[^"]*)"[^>]*>'


@query(f"""WITH h AS (SELECT p_partkey, {_LISTED} AS html FROM part), s AS (SELECT *, strpos(html, '<a class') - 1 AS s1, strpos(html, '<a href') - 1 AS s2 FROM h)
SELECT p_partkey, CAST(0 AS INTEGER) AS place, 'https://shop.example.com/products/' || p_partkey AS target, md5(substr(html, greatest(0, s1 - 4) + 1, least(length(html), s1 + 31 + length(CAST(p_partkey AS VARCHAR)) + 100, s2 + 20) - greatest(0, s1 - 4))) AS w FROM s
UNION ALL SELECT p_partkey, 1, 'https://shop.example.com/products/' || (p_partkey + 1), md5(substr(html, s2 - 4 + 1, least(length(html), s2 + 21 + length(CAST(p_partkey + 1 AS VARCHAR)) + 100) - (s2 - 4))) FROM s""")
def listing_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The text around each product link, no further than into the next one."""
    pages = table(spark, folder, "part").selectExpr("p_partkey", "'https://shop.example.com/all' AS url", f"{_LISTED} AS html")
    return listing.windows(pages, "p_partkey", "url", "html", _MARKER, 4, 100, 20).select("p_partkey", "place", "target", F.md5("window").alias("w"))


@query("""WITH l AS (SELECT o_custkey % 40 AS page, o_custkey AS target, CASE WHEN o_orderkey % 4 = 0 THEN 'Shop now' ELSE o_orderpriority || ' ' || (o_orderkey % 3) END AS label, o_orderkey FROM orders), s AS (SELECT *, CASE WHEN label LIKE '1-%' THEN 100.0 ELSE 0.0 END + CASE WHEN label LIKE '4-%' THEN 0.0 ELSE 30.0 END + length(label) / 100.0 AS score FROM l WHERE label <> 'Shop now'),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page, target ORDER BY score DESC, o_orderkey) = 1) SELECT page, target, o_orderkey, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, o_orderkey) AS INTEGER) AS n FROM b QUALIFY n <= 120""")
def scored_links(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's links by the best of their labels, the first 120 (a top-k report)."""
    o = table(spark, folder, "orders")
    links = o.select((F.col("o_custkey") % 40).alias("page"), F.col("o_custkey").alias("target"), F.when(F.col("o_orderkey") % 4 == 0, "Shop now").otherwise(F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey") % 3)).alias("label"), F.col("o_orderkey").alias("place"))
    return listing.scored_links(links, "page", F.col("label").startswith("1-"), F.col("label").startswith("4-")).select("page", "target", F.col("place").alias("o_orderkey"), "n")


@query("""SELECT user_id, event_type, count(*) AS rows FROM events WHERE event_type <> 'error' QUALIFY true GROUP BY ALL""".replace(" QUALIFY true", "").replace("GROUP BY ALL", "AND (user_id, event_type) IN (SELECT (user_id, min(event_type)) FROM events WHERE event_type <> 'error' GROUP BY user_id) GROUP BY ALL"))
def first_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source the rows of its first route that has any."""
    e = table(spark, folder, "events").where("event_type <> 'error'").select("user_id", "event_type")
    return listing.first_route(e, "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("rows"))


@query("""SELECT o_custkey % 20 AS source, count(DISTINCT o_orderkey) AS uncovered, count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey % 3 = 1) AS read, count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey % 3 = 2) AS failed, CASE WHEN bool_or(o_orderkey % 3 = 2) THEN 'partial' ELSE 'complete' END AS coverage FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1""")
def listing_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Links that a listing's rows do not cover, and what came of their own pages."""
    o = table(spark, folder, "orders").select((F.col("o_custkey") % 20).alias("source"), F.concat(F.lit("https://x/"), "o_orderkey").alias("url"), F.col("o_orderkey").alias("k"))
    structured = o.where("k % 3 = 0").select("source", F.concat("url", F.lit("?variant=1")).alias("url"))
    return listing.scanned(structured, o, o.where("k % 3 = 1").select("source", "url", F.lit(True).alias("ok")), "source")[1]


@query("""SELECT p_partkey FROM part WHERE p_partkey % 7 <> 3 AND p_partkey % 5 <> 1 AND (p_partkey % 3 <> 2 OR (p_partkey % 13 = 6 AND p_partkey % 4 = 0)) AND (p_partkey % 2 = 0 OR p_partkey % 11 = 4) AND NOT (p_partkey % 13 = 6 AND p_partkey % 4 <> 0)""")
def admitted_flowers(spark: SparkSession, folder: str) -> DataFrame:
    """Listing rows that are a product of the kind wanted, and are proved to be."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("Item "), F.when(k % 3 != 2, "flower ").otherwise(""), F.when(k % 5 == 1, "<b>hoodie</b> ").otherwise(""), F.when(k % 13 == 6, "resin jar ").otherwise(""), F.when((k % 13 == 6) & (k % 4 == 0), "flower buds").otherwise(""))
    rows = table(spark, folder, "part").select("p_partkey", name.alias("name"), F.when(k % 2 == 0, "THCA &amp; more").alias("description"), F.when(k % 7 != 3, "https://x/1").alias("url"), F.when(k % 11 == 4, "https://x/THCA-all").otherwise("https://x/all").alias("route_url"))
    return listing.admitted(rows, r"(?i)\bhoodie\b", r"(?i)\bflower\b", r"(?i)\bthca\b", r"(?i)\bresin\b", r"(?i)\bjar\b", r"(?i)flower buds").select("p_partkey")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'transport_timeout' WHEN 1 THEN 'tls_certificate_error' WHEN 2 THEN 'dns_failure' WHEN 3 THEN 'processing_error' ELSE 'connection_failure' END AS category, event_id % 5 IN (0, 4) AS transient, event_id % 700 IN (202, 408, 425, 429) OR event_id % 700 BETWEEN 500 AND 599 AS retryable FROM events""")
def failure_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Failures by their class, and answers that are worth another attempt."""
    k = F.col("event_id") % 5
    name = F.when(k == 0, "TimeoutError").when(k == 1, "SSLCertVerificationError").when(k == 2, "gaierror").when(k == 3, "KeyError").otherwise("ConnectionError")
    f = table(spark, folder, "events").select("event_id", listing.failure(name).alias("f"), listing.retryable((F.col("event_id") % 700).cast("string")).alias("retryable"))
    return f.select("event_id", "f.category", F.col("f.retryable").alias("transient"), "retryable")
