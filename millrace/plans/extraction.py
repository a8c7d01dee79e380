"""Identities, addresses, pages, labels and documents' facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import addresses, extract, hashing, text
from millrace.functions.numbers import largest_percent
from millrace.operators.segments import fit_segments
from millrace.plans.registry import query
from millrace.sources import pages as html
from millrace.sources.tables import table


@query("SELECT p_partkey, substr(sha256(p_brand || chr(31) || p_name || chr(31) || coalesce(CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) END, '')), 1, 24) AS id FROM part")
def stable_digest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", hashing.digest("p_brand", "p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_size"))).alias("id"))


@query("""WITH t AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'source_id' WHEN p_partkey % 3 = 1 THEN 'handle' ELSE 'title' END AS method, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 3 = 1 THEN p_type ELSE p_name END AS v FROM part)
SELECT p_partkey, substr(sha256(p_brand || chr(31) || method || chr(31) || v), 1, 24) AS id, method FROM t""")
def identity_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """The first of several identities that is there, and which."""
    rungs = [("source_id", F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey"))), ("handle", F.when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise("")), ("title", F.col("p_name"))]
    return table(spark, folder, "part").select("p_partkey", hashing.ladder(rungs, "p_brand").alias("i")).select("p_partkey", "i.*")


@query("SELECT shard, count(*) AS rows, min(p_partkey) AS first, max(p_partkey) AS last FROM (SELECT p_partkey, CAST(CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 16 AS INTEGER) AS shard FROM part) GROUP BY shard")
def hash_shards(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", hashing.bucket(F.sha2(F.col("p_partkey").cast("string"), 256), 16).alias("shard"))
    return p.groupBy("shard").agg(F.count("*").alias("rows"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


@query(r"""WITH t AS (SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1, 'i')) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1, 'i')) AS host, regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1, 'i'), '/{2,}', '/', 'g'), '/+$', '') AS path,
 regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages), u AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT lower(split_part(p, '=', 1)) LIKE 'utm\_%' ESCAPE '\')), '&') AS kept FROM t)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS product, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS document, regexp_replace(host, '^www\.', '') AS host FROM u""")
def canonical_url(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", addresses.product_address("url").alias("product"), addresses.document_address("url").alias("document"), addresses.host("url").alias("host"))


_URL = """'HTTPS://Shop.Example.com//p/' || page_id || '/?utm_source=a&' || CASE page_id % 5 WHEN 0 THEN 'Variant=' || (page_id % 7) WHEN 1 THEN 'variation_id=' || page_id || '&attribute_size=' || (page_id % 9) || '+g' WHEN 2 THEN 'sku=' || page_id
 WHEN 3 THEN 'variant=&attribute_pa_size=half%20oz' ELSE 'variant=b&variant=a%2f' END || CASE WHEN page_id % 4 = 0 THEN '&token=x' WHEN page_id % 4 = 1 THEN '&ref=y#top' ELSE '' END"""


@query(f"""WITH t AS (SELECT page_id, {_URL} AS u FROM pages), q AS (SELECT page_id, regexp_extract(u, '[?]([^#]*)', 1) AS q FROM t),
p AS (SELECT page_id, unnest(string_split(q, '&')) AS p FROM q),
k AS (SELECT page_id, string_agg(split_part(p, '=', 1) || '=' || replace(replace(replace(split_part(p, '=', 2), '%20', '+'), '%2f', '%2F'), ' ', '+'), '&' ORDER BY split_part(p, '=', 1), split_part(p, '=', 2)) AS kept
 FROM p WHERE lower(split_part(p, '=', 1)) IN ('variant', 'attribute_pa_size', 'attribute_size', 'variation_id') AND split_part(p, '=', 2) <> '' GROUP BY page_id)
SELECT page_id, 'https://shop.example.com/p/' || page_id || coalesce('?' || kept, '') AS variant, contains(q, '&token=') AS expiring, true AS public, 'https://Shop.Example.com//p/' || page_id || '/?' || q AS detail FROM q LEFT JOIN k USING (page_id)""")
def variant_url(spark: SparkSession, folder: str) -> DataFrame:
    """Of each address's query what names a variant: four keys, in order, spelled alike."""
    t = table(spark, folder, "pages").select("page_id", F.expr(_URL).alias("u"))
    return t.select("page_id", addresses.variant_address("u").alias("variant"), addresses.expiring("u").alias("expiring"), addresses.public("u").alias("public"), addresses.detail_target("u").alias("detail"))


@query(r"""SELECT page_id, lang, md5(title) AS title_md5, length(title) AS title_chars FROM (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
 trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages)""")
def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages").select("page_id", F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"), html.title("html").alias("title"))
    return p.select("page_id", "lang", F.md5("title").alias("title_md5"), F.length("title").cast("long").alias("title_chars"))


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), t AS (SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM a WHERE href LIKE '/%')
SELECT page_id, count(DISTINCT root || regexp_replace(regexp_replace(replace(href, '&amp;', '&'), '[?#].*$', ''), '/+$', '')) AS links FROM t GROUP BY page_id""")
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct canonical link targets a page."""
    found = html.links(table(spark, folder, "pages").where("html IS NOT NULL"), "page_id", "url", "html")
    return found.groupBy("page_id").agg(F.count("*").alias("links"))


@query(r"""SELECT page_id, lower(regexp_extract(m, 'name="([^"]+)"', 1)) AS name, count(*) AS tags FROM (SELECT page_id, unnest(regexp_extract_all(html, '<meta\s[^>]*name="[^"]+"[^>]*>', 0)) AS m FROM pages) GROUP BY ALL
UNION ALL SELECT page_id, 'charset', count(*) FROM (SELECT page_id, unnest(regexp_extract_all(html, '<meta charset="([^"]+)"', 1)) AS m FROM pages) GROUP BY page_id""")
def meta_tags(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages")
    named = html.metas(p, "page_id", "html").groupBy("page_id", "name").agg(F.count("*").alias("tags"))
    plain = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<meta charset="([^"]+)"'), F.lit(1))).alias("c")).groupBy("page_id").agg(F.count("*").alias("tags"))
    return named.unionByName(plain.select("page_id", F.lit("charset").alias("name"), "tags"))


_LABELS = """CASE p_partkey % 9 WHEN 0 THEN '3.5 grams' WHEN 1 THEN 'Pack of 1/8 oz' WHEN 2 THEN 'half pound' WHEN 3 THEN 'quarter' WHEN 4 THEN '1/2 lb bag' WHEN 5 THEN 'Ounce' WHEN 6 THEN '1/4' WHEN 7 THEN 'choose size' ELSE '28g jar' END"""


@query(f"""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 3.5 WHEN 1 THEN 3.5 WHEN 2 THEN 224.0 WHEN 3 THEN 7.0 WHEN 4 THEN 224.0 WHEN 5 THEN 28.0 WHEN 6 THEN 7.0 WHEN 7 THEN NULL ELSE 28.0 END::DOUBLE AS grams,
 CASE WHEN p_partkey % 9 = 7 THEN 'unlabelled' WHEN p_partkey % 9 IN (5, 8) AND p_size = 28 THEN 'agreed' WHEN p_partkey % 9 IN (3, 6) AND p_size = 7 THEN 'agreed' ELSE 'conflict' END AS method0 FROM part""".replace("AS method0 FROM part", "AS check_method FROM part"))
def weight_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Grams of package labels, and whether a number beside the label agrees with it."""
    labels = F.expr(_LABELS)
    t = table(spark, folder, "part").select("p_partkey", extract.label_grams(labels)["grams"].alias("grams"), extract.weight(F.col("p_size"), labels)["method"].alias("check_method"))
    return t


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 5 THEN true END AS in_stock, CASE o_orderkey % 6 WHEN 3 THEN 'missing' WHEN 4 THEN 'unknown' ELSE 'source_state' END AS method FROM orders""")
def stock_states(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases that deny beat those that affirm."""
    state = F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Sold-Out' WHEN 2 THEN 'not currently available' WHEN 3 THEN '' WHEN 4 THEN 'soon' ELSE 'available for order' END")
    return table(spark, folder, "orders").select("o_orderkey", extract.stock(state).alias("s")).select("o_orderkey", "s.*")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'bulky' END, CASE WHEN p_name LIKE '%widget%' THEN 'widget' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END], lambda x: x IS NOT NULL), ',') AS tags,
 CASE WHEN p_type = 'PROMO' THEN 'offer' WHEN p_name LIKE 'red%' OR p_name LIKE 'blue%' THEN 'coloured' ELSE 'unknown' END AS category FROM part""")
def type_tag_order(spark: SparkSession, folder: str) -> DataFrame:
    flags = [("bulky", F.col("p_size") > 40), ("widget", F.col("p_name").contains("widget")), ("promo", F.col("p_type") == "PROMO")]
    rule = extract.first_rule(F.concat_ws(" ", F.col("p_type"), F.col("p_name")), [("^PROMO", "offer"), (r"^\w+ (?:red|blue)", "coloured")])
    return table(spark, folder, "part").select("p_partkey", F.array_join(extract.ordered_tags(flags), ",").alias("tags"), rule.alias("category"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'indoor' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'outdoor' WHEN c_custkey % 2 = 0 THEN 'greenhouse' ELSE 'unknown' END AS value,
 CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'explicit' WHEN c_custkey % 2 = 0 THEN 'text' ELSE 'unavailable' END AS source FROM customer""")
def mapped_category(spark: SparkSession, folder: str) -> DataFrame:
    """An explicit value by a table, else the first rule on a description."""
    names = {"building": "indoor", "machinery": "indoor", "automobile": "outdoor"}
    words = F.when(F.col("c_custkey") % 2 == 0, F.lit("grown in Mixed-Light")).otherwise(F.lit("plain"))
    v = extract.mapped_or_rule("c_mktsegment", names, words, [(r"\bmixed light\b", "greenhouse"), (r"\bindoor\b", "indoor")])
    return table(spark, folder, "customer").select("c_custkey", v.alias("v")).select("c_custkey", "v.*")


_SHARES = "concat(text, CASE WHEN doc_id % 3 = 0 THEN concat(' then ', doc_id % 120, '.5 % and ', doc_id % 7, '%, 1000%') WHEN doc_id % 3 = 1 THEN ' none % here' ELSE '' END)"


@query(rf"""SELECT doc_id, list_max(list_transform(regexp_extract_all({_SHARES}, '(\d{{1,3}}(?:\.\d+)?)\s*%', 1), lambda x: CAST(x AS DOUBLE))) AS percent FROM documents""")
def largest_percents(spark: SparkSession, folder: str) -> DataFrame:
    """The largest percentage of each document, null where there is none."""
    d = table(spark, folder, "documents").selectExpr("doc_id", f"{_SHARES} AS text")
    return d.select("doc_id", largest_percent("text").alias("percent"))


@query("""SELECT o_orderkey, array_to_string(list_distinct_keep, '|') AS items FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [o_orderpriority, o_orderstatus] ELSE [o_orderstatus, o_orderpriority] END AS list_distinct_keep FROM orders)""")
def distinct_items(spark: SparkSession, folder: str) -> DataFrame:
    """The same item in another case counts once; order of first appearance stays."""
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    items = F.when(F.col("o_orderkey") % 2 == 0, F.array(b, a, F.lower(b))).otherwise(F.array(a, F.lower(a), b, F.concat(F.lit(" "), b)))
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(extract.distinct_items(items), "|").alias("items"))


@query("""SELECT p_partkey, p_name || ' ' || (p_partkey % 5) AS name FROM part""")
def canonical_name(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing marketing words go, one after another, but never the whole name."""
    own = F.concat_ws(" ", "p_name", (F.col("p_partkey") % 5).cast("string"))
    raw = F.concat(own, F.lit(" - Premium | indoor"), F.when(F.col("p_partkey") % 2 == 0, " - best seller").otherwise(""))
    return table(spark, folder, "part").select("p_partkey", text.strip_suffixes(raw, ["indoor", "best seller", "premium"]).alias("name"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_md5 FROM documents""")
def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Entities, ligatures and decomposed letters put into all texts, and taken out again by cleaning them."""
    t = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("&eacute;")), F.lit("fi"), F.lit("ﬁ"))
    t = F.replace(F.replace(t, F.lit("ü"), F.lit("u\u0308")), F.lit("o t"), F.lit("o&#32;&#x74;"))
    return table(spark, folder, "documents").select("doc_id", F.md5(text.clean_text(t)).alias("clean_md5"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT greatest(32, CAST(ceil(sum(octet_length(encode(coalesce(text, '')))) / 67108864.0) AS BIGINT)) FROM documents) AS INTEGER) AS bucket FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS n FROM d),
s AS (SELECT doc_id, bytes, bucket, n, 0 AS segment, bytes AS used FROM r WHERE n = 1
UNION ALL SELECT r.doc_id, r.bytes, r.bucket, r.n, CASE WHEN s.used + r.bytes > 262144 THEN s.segment + 1 ELSE s.segment END, CASE WHEN s.used + r.bytes > 262144 THEN r.bytes ELSE s.used + r.bytes END FROM s JOIN r ON r.bucket = s.bucket AND r.n = s.n + 1)
SELECT doc_id, bucket, CAST(bytes AS INTEGER) AS bytes, CAST(segment AS INTEGER) AS segment FROM s""")
def byte_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Documents dealt by a hash of their identity to buckets of some 64 MiB, 32 at least, and in each to segments of at most 256 KiB."""
    d = table(spark, folder, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    buckets = max(32, -(-(d.agg(F.sum("bytes")).first()[0] or 0) // (64 << 20)))
    d = d.select("doc_id", hashing.bucket(F.sha2(F.col("doc_id").cast("string"), 256), buckets).alias("bucket"), "bytes")
    return fit_segments(d, "bucket", ["doc_id"], "bytes", 1 << 18)
