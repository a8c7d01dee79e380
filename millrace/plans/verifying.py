"""Assertions over whole datasets, and products reconciled by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import reconcile, verification
from millrace.plans.publishing import _OFFERS, _offers, _volume
from millrace.plans.registry import query
from millrace.sources.tables import table

# The index of a catalogue with all kinds of faults, by expressions that both engines read.
_PRODUCT = {
    "product_id": "CASE WHEN p_partkey % 211 = 5 THEN CAST(p_partkey - 1 AS STRING) WHEN p_partkey % 223 = 6 THEN '' ELSE CAST(p_partkey AS STRING) END", "vendor_id": "CASE WHEN p_partkey % 101 = 1 THEN ' ' ELSE p_brand END", "vendor_name": "CASE WHEN p_partkey % 103 = 2 THEN NULL ELSE p_brand END",
    "strain_name": "CASE WHEN p_partkey % 107 = 3 THEN '' ELSE p_name END", "lineage": "CASE p_partkey % 7 WHEN 0 THEN 'indica' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'sativa' WHEN 3 THEN 'unknown' WHEN 4 THEN 'sativa_leaning_hybrid' WHEN 5 THEN 'indica_leaning_hybrid' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'indica' END END",
    "rating": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size / CAST(10 AS DOUBLE) END", "review_count": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END", "default_variant_id": "concat(p_partkey % 50, '-1-', p_partkey % 7)", "canonical_product_url": "concat('https://shop.example.com/', p_partkey - p_partkey % 3)",
}
_VARIANT = {
    "product_id": "CAST(l_partkey AS STRING)", "variant_id": "concat(l_orderkey, '-', l_linenumber, '-', l_suppkey)", "in_stock": "l_suppkey % 13 <> 4", "grams": "CASE WHEN l_orderkey % 97 = 0 THEN 0.0 ELSE l_quantity END", "current_price": "l_extendedprice",
    "price_per_gram": "CASE WHEN l_orderkey % 89 = 1 THEN 1.0 ELSE l_extendedprice / l_quantity END", "original_price": "CASE l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN l_extendedprice - 1 ELSE l_extendedprice * 2 END",
    "discount_percent": "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 49.0 ELSE 50.01 END", "url": "concat('https://shop.example.com/', l_partkey)", "source_variant_id": "CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE concat('s', l_suppkey) END", "batch": "CASE WHEN l_linenumber % 2 = 0 THEN concat(' B', l_suppkey % 11) END", "lot": "concat('l', l_orderkey % 6)",
}


def _select(expressions: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in expressions.items())} FROM {source}"


_INDEX = f"i AS ({_select(_PRODUCT, 'part')}), v AS ({_select(_VARIANT, 'lineitem')})"


def _index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = [table(spark, folder, t).selectExpr(*(f"{e} AS {n}" for n, e in x.items())) for t, x in (("part", _PRODUCT), ("lineitem", _VARIANT))]
    return parts[0], parts[1]


def _cases(key: str, source: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", {key} AS key FROM {source} WHERE {rule}" for name, rule in checks.items())


@query(f"WITH {_INDEX} " + _cases("product_id", "i", {"missing_vendor_id": "trim(vendor_id) = ''", "missing_vendor_name": "vendor_name IS NULL", "missing_strain_name": "strain_name = ''", "invalid_lineage": "lineage = 'other'", "rating_nullability": "(rating IS NULL) <> (review_count IS NULL)"})
 + " UNION ALL " + _cases("variant_id", "v", {"not_in_stock": "NOT in_stock", "pricing_inconsistency": "grams <= 0 OR current_price <= 0 OR abs(current_price / grams - price_per_gram) > 0.001", "invalid_original_price": "original_price <= current_price",
 "discount_inconsistency": "original_price > current_price AND (discount_percent IS NULL OR abs((original_price - current_price) / original_price * 100 - discount_percent) > 0.02)", "discount_without_original": "original_price IS NULL AND discount_percent IS NOT NULL"})
 + """ UNION ALL SELECT 'product_id_not_unique', product_id FROM i GROUP BY product_id HAVING count(*) > 1 OR product_id = '' UNION ALL SELECT 'variant_id_not_unique', variant_id FROM v GROUP BY variant_id HAVING count(*) > 1
 UNION ALL SELECT 'weight_not_unique', product_id || '|' || printf('%.4f', grams) FROM v GROUP BY product_id, grams HAVING count(*) > 1 UNION ALL SELECT 'product_without_variants', product_id FROM i WHERE product_id NOT IN (SELECT product_id FROM v)
 UNION ALL SELECT 'default_variant_mismatch', i.product_id FROM i JOIN (SELECT product_id, variant_id FROM v WHERE in_stock QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price_per_gram, current_price, grams, variant_id) = 1) c USING (product_id) WHERE i.default_variant_id <> c.variant_id""")  # fmt: skip
def index_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The compact index against all its rules."""
    return verification.index_checks(*_index(spark, folder))


@query(f"""WITH {_INDEX}, d AS (SELECT * FROM i WHERE product_id NOT LIKE '%7'), w AS (SELECT variant_id, CASE WHEN product_id LIKE '%3' THEN grams + 1 ELSE grams END AS grams, CASE WHEN product_id LIKE '%4' THEN url || '?' ELSE url END AS url FROM v WHERE product_id NOT LIKE '%2'),
 u AS (SELECT DISTINCT variant_id, grams, url, product_id FROM v)
SELECT 'product_left_only' AS "check", product_id AS key FROM (SELECT DISTINCT product_id FROM i) WHERE product_id NOT IN (SELECT product_id FROM d) UNION ALL SELECT 'variant_left_only', variant_id FROM (SELECT DISTINCT variant_id FROM v) WHERE variant_id NOT IN (SELECT variant_id FROM w)
UNION ALL SELECT 'weight_mismatch', variant_id FROM v JOIN w USING (variant_id) WHERE abs(v.grams - w.grams) > 0.0001 UNION ALL SELECT 'url_mismatch', variant_id FROM v JOIN w USING (variant_id) WHERE v.url <> w.url
UNION ALL SELECT 'product_url_not_unique', vendor_id || '|' || canonical_product_url FROM d GROUP BY vendor_id, canonical_product_url HAVING count(*) > 1""")
def index_detail_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Index and details hold the same."""
    i, v = _index(spark, folder)
    d = i.where("product_id NOT LIKE '%7'")
    w = v.where("product_id NOT LIKE '%2'").select("variant_id", F.when(F.col("product_id").endswith("3"), F.col("grams") + 1).otherwise(F.col("grams")).alias("grams"), F.when(F.col("product_id").endswith("4"), F.concat("url", F.lit("?"))).otherwise(F.col("url")).alias("url"))
    return verification.parity_checks(i, v, d, w)


_DOCUMENT = {
    "document_id": "concat('d', l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey)", "held_product_id": "CAST(l_partkey AS STRING)", "held_variant_id": "concat(l_orderkey, '-', l_linenumber, '-', l_suppkey)", "held_vendor_id": "'v'", "product_id": "CASE WHEN l_orderkey % 19 = 2 THEN '?' ELSE CAST(l_partkey AS STRING) END",
    "vendor_id": "CASE WHEN l_orderkey % 17 = 1 THEN 'w' ELSE 'v' END", "scope": "CASE l_orderkey % 6 WHEN 0 THEN 'variant' WHEN 1 THEN 'weight' WHEN 2 THEN 'batch' WHEN 3 THEN 'product' WHEN 4 THEN 'vendor' ELSE 'all' END", "variant_id": "CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE concat(l_orderkey, '-', l_linenumber, '-', l_suppkey) END",
    "source_variant_id": "CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('s', l_suppkey) WHEN 2 THEN 'x' ELSE concat(l_orderkey, '-', l_linenumber, '-', l_suppkey) END", "grams": "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN l_quantity ELSE l_quantity + 0.02 END", "batch": "concat('b', l_suppkey % 11)", "lot": "CASE WHEN l_linenumber % 3 = 0 THEN concat('L', l_orderkey % 7) END",
}


@query(f"""WITH {_INDEX}, d AS ({_select(_DOCUMENT, "lineitem")}), u AS (SELECT variant_id AS held_variant_id, source_variant_id AS vs, grams AS vg, batch AS vb, lot AS vl FROM v),
 r AS (SELECT *, document_id || '|' || held_variant_id AS k FROM d JOIN u USING (held_variant_id)) """ + _cases("k", "r", {
    "document_vendor_mismatch": "vendor_id <> 'v'", "document_product_mismatch": "product_id = '?'", "document_invalid_scope": "scope = 'all'", "document_variant_mismatch": "scope IN ('variant', 'weight', 'batch') AND variant_id <> held_variant_id",
    "broad_document_has_variant": "scope IN ('product', 'vendor') AND variant_id <> ''", "document_source_variant_mismatch": "scope = 'variant' AND (source_variant_id = '' OR (source_variant_id <> held_variant_id AND source_variant_id <> vs))", "document_weight_missing": "scope = 'weight' AND grams IS NULL",
    "document_weight_mismatch": "scope = 'weight' AND abs(grams - vg) > 0.01", "document_batch_mismatch": "scope = 'batch' AND NOT (list_contains([lower(batch), lower(lot)], lower(trim(vb))) IS TRUE OR list_contains([lower(batch), lower(lot)], vl) IS TRUE)",
}))
def document_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against the variants that hold them; where several variants have one id, against each of them."""
    d = table(spark, folder, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in _DOCUMENT.items()))
    return verification.document_checks(d, _index(spark, folder)[1])


@query(f"""WITH {_INDEX}, d AS (SELECT product_id, CASE WHEN p_partkey % 9 = 0 AND p_partkey % 4 <> 0 THEN 'unavailable' ELSE 'page' END AS ps, CASE WHEN p_partkey % 8 = 1 THEN 'mixed' ELSE 'atomic_source_record_pair' END AS pm, CASE WHEN p_partkey % 12 = 5 THEN 1.0 ELSE p_size / CAST(10 AS DOUBLE) END AS rs,
 CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS rc, CASE WHEN p_partkey % 15 = 2 THEN '' ELSE 'r' END AS sr FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS product_id FROM part)),
 j AS (SELECT d.*, i.rating, i.review_count FROM d JOIN i USING (product_id)) """ + _cases("product_id", "j", {
    "unrated_with_origin": "rating IS NULL AND ps <> 'unavailable'", "rating_not_atomic": "rating IS NOT NULL AND pm = 'mixed'", "rating_value_mismatch": "rating IS NOT NULL AND (rs IS DISTINCT FROM rating OR rc IS DISTINCT FROM review_count)", "rating_without_source_record_id": "rating IS NOT NULL AND sr = ''",
}))
def rating_violations(spark: SparkSession, folder: str) -> DataFrame:
    k, p = F.col("p_partkey"), table(spark, folder, "part")
    d = p.select(
        k.cast("string").alias("product_id"), F.when((k % 9 == 0) & (k % 4 != 0), "unavailable").otherwise("page").alias("provenance_source"), F.when(k % 8 == 1, "mixed").otherwise("atomic_source_record_pair").alias("provenance_method"), F.when(k % 12 == 5, 1.0).otherwise(F.col("p_size") / 10).alias("raw_score"),
        F.when(k % 10 != 0, F.col("p_size")).alias("raw_count"), F.when(k % 15 == 2, "").otherwise("r").alias("source_record_id"), F.lit("p").alias("source_path"), F.lit("t").alias("collected_at"),
    )
    return verification.rating_checks(d, _index(spark, folder)[0])


@query("""SELECT 'products_count_mismatch' AS "check", '3|' || count(*) AS key FROM part UNION ALL SELECT 'nations_count_mismatch', '24|' || count(*) FROM nation WHERE (SELECT count(*) FROM nation) <> 24""")
def count_violations(spark: SparkSession, folder: str) -> DataFrame:
    return verification.count_checks({"products": 3, "nations": 24, "regions": 5}, {"products": table(spark, folder, "part"), "nations": table(spark, folder, "nation"), "regions": table(spark, folder, "region")})


@query("""WITH f AS (SELECT 'p' || page_id AS path, html AS content FROM pages WHERE page_id % 50 <> 3), d AS (SELECT 'p' || page_id AS path, CASE WHEN page_id % 40 = 1 THEN 'x' ELSE sha256(html) END AS sha256, octet_length(encode(html)) + CASE WHEN page_id % 30 = 2 THEN 1 ELSE 0 END AS bytes FROM pages),
 j AS (SELECT d.*, content, sha256(content) AS s, octet_length(encode(content)) AS b FROM d LEFT JOIN f USING (path)) """ + _cases("path", "j", {"file_missing": "content IS NULL", "file_hash_mismatch": "s <> sha256", "file_bytes_mismatch": "b <> bytes", "file_too_large": "b > 20000"}))
def file_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Declared hashes and sizes against the files' own."""
    k, p = F.col("page_id"), table(spark, folder, "pages")
    path = F.concat(F.lit("p"), k)
    d = p.select(path.alias("path"), F.when(k % 40 == 1, "x").otherwise(F.sha2("html", 256)).alias("sha256"), (F.octet_length("html") + F.when(k % 30 == 2, 1).otherwise(0)).alias("bytes"))
    return verification.file_checks(d, p.where("page_id % 50 <> 3").select(path.alias("path"), F.col("html").alias("content")), 20_000)


@query(f"""WITH {_OFFERS}, r AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM o) """ + _cases("k", "r", {
    "invalid_type_evidence": "NOT coalesce(CASE primary_type WHEN 'cannabis_flower' THEN explicit_thca AND explicit_flower WHEN 'cannabis_vape' THEN explicit_cannabis AND explicit_vape WHEN 'psilocybin_mushroom' THEN explicit_psilocybin AND explicit_mushroom AND NOT explicit_vape AND NOT amanita_signal WHEN 'psilocybin_vape' THEN explicit_psilocybin AND explicit_vape AND NOT amanita_signal END, false)",
    "controlled_link": "primary_type LIKE 'psilocybin%'",
}))
def type_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without evidence of their type, and controlled ones with links."""
    return verification.type_checks(_offers(spark, folder), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


_LABEL = "CASE l_suppkey % 4 WHEN 0 THEN '2 ml' WHEN 1 THEN '1g' WHEN 2 THEN '1 g / 2ml' ELSE 'pen' END"
_REASON = "CASE l_orderkey % 6 WHEN 0 THEN 'unsupported_vape_mass_quantity' WHEN 1 THEN 'missing_vape_volume' WHEN 2 THEN 'missing_vape_other' WHEN 3 THEN 'missing_name' ELSE 'inconsistent_vape_quantity' END"


@query(f"""WITH {_OFFERS}, r AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, {_LABEL} AS label, {_REASON} AS reason FROM o),
 p AS (SELECT k, CASE {_volume("true")} END AS first, * FROM r WHERE primary_type LIKE '%vape') """ + _cases("k", "p", {
    "unsupported_vape_mass_quantity": "quantity_unit = 'g' OR grams > 0", "missing_vape_volume": "quantity_unit IS DISTINCT FROM 'ml' OR volume_ml IS NULL", "inconsistent_vape_quantity": "abs(quantity_value - volume_ml) > 0.0001",
    "missing_vape_comparison_price": "comparison_metric <> 'price_per_ml' OR comparison_price IS NULL OR price_per_ml IS NULL",
    "inconsistent_vape_comparison_price": "coalesce(abs(comparison_price - price_per_ml) > 0.0001, false) OR coalesce(abs(price_per_ml - (CASE WHEN TRY_CAST(price AS DOUBLE) > 0 THEN TRY_CAST(price AS DOUBLE) END) / volume_ml) > 0.0001, false) OR volume_ml IS NULL OR NOT coalesce(TRY_CAST(price AS DOUBLE) > 0, false)",
}) + " UNION ALL " + _cases("k", "r", {
    "mass_only_with_other_reason": "primary_type LIKE '%vape' AND label = '1g' AND reason <> 'unsupported_vape_mass_quantity'", "unknown_quantity_reason": "reason = 'missing_vape_other'", "mass_reason_without_label": "reason = 'unsupported_vape_mass_quantity' AND label IN ('2 ml', 'pen')",
}))
def quantity_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Published and rejected rows that are sold by volume."""
    rows = _offers(spark, folder).withColumns({"label": F.expr(_LABEL), "reason": F.expr(_REASON)})
    return verification.quantity_checks(rows, rows, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.col("label"))


_SHARD = {"file": "CASE WHEN s_suppkey % 23 = 1 THEN 'other.json' ELSE concat('a/shard-', s_suppkey - s_suppkey % 2, '.json') END", "schema_version": "CASE WHEN s_suppkey % 19 = 2 THEN 'v0' ELSE 'v1' END", "source_commit": "CASE s_suppkey % 17 WHEN 3 THEN 'short' WHEN 4 THEN '1234567890123456789012345678901234567890' ELSE 'abcdefabcdefabcdefabcdefabcdefabcdefabcd' END"}


@query(f"WITH s AS ({_select(_SHARD, 'supplier')}) " + _cases("file", "s", {"shard_schema": "schema_version = 'v0'", "shard_name": "file = 'other.json'", "shard_commit_form": "source_commit = 'short'", "shard_commit_mismatch": "source_commit NOT LIKE 'abc%'"})
 + " UNION ALL SELECT 'shard_number_not_unique', n FROM (SELECT regexp_extract(file, 'shard-([0-9]+)', 1) AS n FROM s WHERE file <> 'other.json') GROUP BY n HAVING count(*) > 1")
def shard_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in _SHARD.items()))
    return verification.shard_checks(rows, "abcdefabcdefabcdefabcdefabcdefabcdefabcd", "v1")


_VENDOR = {"vendor_id": "CASE WHEN s_suppkey % 29 = 1 THEN 'v0' ELSE concat('v', s_suppkey) END", "vendor_name": "CASE WHEN s_suppkey % 31 = 2 THEN ' ' ELSE s_name END", "classification": "CASE WHEN s_suppkey % 37 = 3 THEN NULL ELSE 'c' END", "display": "CASE WHEN s_suppkey % 41 = 4 THEN '' ELSE 'd' END"}
_ROUTE = {"vendor_id": "concat('v', s_suppkey)", "type": "CASE WHEN s_suppkey % 11 = 5 THEN 'rss' ELSE 'html' END", "url": "CASE WHEN s_suppkey % 13 = 6 THEN 'http://x' ELSE 'https://x' END", "scope": "CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'all' END"}


@query(f"WITH s AS ({_select(_VENDOR, 'supplier')}), r AS ({_select(_ROUTE, 'supplier')} WHERE s_suppkey % 5 <> 0) SELECT 'too_few_vendors' AS \"check\", CAST(count(*) AS VARCHAR) AS key FROM s HAVING count(*) < 1000000 UNION ALL SELECT 'vendor_id_not_unique', vendor_id FROM s GROUP BY vendor_id HAVING count(*) > 1 UNION ALL "
 + _cases("vendor_id", "s", {"vendor_without_name": "trim(vendor_name) = ''", "age_check_missing": "classification IS NULL OR display = ''", "routes_missing": "vendor_id NOT IN (SELECT vendor_id FROM r)"}) + " UNION ALL "
 + _cases("vendor_id || '|' || url", "r", {"route_type": "type = 'rss'", "route_not_https": "url = 'http://x'", "route_without_scope": "scope = ''"}))
def registry_violations(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    routes = s.where("s_suppkey % 5 <> 0").selectExpr(*(f"{e} AS {n}" for n, e in _ROUTE.items()))
    return verification.registry_checks(s.selectExpr(*(f"{e} AS {n}" for n, e in _VENDOR.items())), routes, 1_000_000, ["html", "json"])


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'g0' ELSE 'g1' END AS g, event_id % 11 <> 2 AS s, event_id % 13 <> 3 AS h, event_id % 17 <> 4 AS c, ts AS a, ts - INTERVAL 10 MINUTE AS b FROM events)
SELECT event_id, CASE WHEN g IS NULL THEN 'missing' WHEN NOT s THEN 'schema' WHEN NOT c THEN 'incomplete' WHEN g = 'g0' THEN 'generation' WHEN NOT h THEN 'hash' WHEN epoch(date_trunc('second', a)) - epoch(TIMESTAMP '2024-01-15 12:00:00') > 60 THEN 'future'
 WHEN epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(date_trunc('second', b)) > 1800 THEN 'expired' ELSE 'ok' END AS code FROM t""")
def cached_states(spark: SparkSession, folder: str) -> DataFrame:
    """Why a cached generation may not be used: the first reason."""
    k, e = F.col("event_id"), table(spark, folder, "events")
    rows = e.select(k, F.when(k % 31 == 0, None).when(k % 7 == 1, "g0").otherwise("g1").alias("generation_id"), (k % 11 != 2).alias("schema_ok"), (k % 13 != 3).alias("hash_ok"), (k % 17 != 4).alias("complete"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("cached_at"))
    rows = rows.withColumn("generated_at", F.expr("cached_at - INTERVAL 10 MINUTES"))
    return verification.cached_state(rows, "g1", F.lit("2024-01-15 12:00:00").cast("timestamp")).select("event_id", "code")


# Products whose vendors and addresses coincide, and all their variants.
_ADDRESSED = """a AS (SELECT p_partkey AS product_id, 'v' || (p_partkey % 5) AS vendor_id, p_name AS url, CASE p_partkey % 5 WHEN 0 THEN 'source_product_identity' WHEN 1 THEN 'canonical_storefront_handle' WHEN 2 THEN 'canonical_product_url' WHEN 3 THEN 'conservative_vendor_title_fallback' ELSE 'none' END AS method, 4 - CASE WHEN p_partkey % 5 = 4 THEN 4 ELSE p_partkey % 5 END AS authority,
 p_size % 4 AS completeness, CAST(p_partkey % 3 AS VARCHAR) AS collected_at FROM part),
v AS (SELECT l_partkey AS product_id, 'v' || (l_orderkey % 40) AS variant_id, l_quantity AS grams, l_extendedprice AS price, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 's' || l_suppkey END AS source_variant_id, CAST(l_orderkey AS VARCHAR) AS collected_at, l_linenumber % 3 AS filled, l_orderkey, l_linenumber, l_suppkey FROM lineitem),
n AS (SELECT a.*, coalesce(c, 0) AS variants FROM a LEFT JOIN (SELECT product_id, count(*) AS c FROM v GROUP BY product_id) USING (product_id)),
s AS (SELECT *, first_value(product_id) OVER (PARTITION BY vendor_id, url ORDER BY authority DESC, variants DESC, completeness DESC, collected_at DESC, product_id DESC) AS kept_id, count(*) OVER (PARTITION BY vendor_id, url) AS candidates FROM n)"""
_UNITED = _ADDRESSED + """, j AS (SELECT v.*, s.kept_id, s.candidates FROM v JOIN s USING (product_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY kept_id, variant_id ORDER BY filled DESC, source_variant_id <> '' DESC, collected_at DESC, product_id, l_orderkey, l_linenumber, l_suppkey, grams, price) AS n FROM j),
w AS (SELECT *, CASE WHEN candidates > 1 AND n > 1 THEN 'variant_id' END AS lost1, CASE WHEN candidates > 1 THEN printf('%.4f', grams) ELSE 'own ' || product_id || ' ' || variant_id || ' ' || l_orderkey || ' ' || l_linenumber || ' ' || l_suppkey END AS weight FROM r),
z AS (SELECT *, row_number() OVER (PARTITION BY kept_id, weight ORDER BY lost1 IS NOT NULL, filled DESC, source_variant_id <> '' DESC, collected_at DESC, variant_id DESC, product_id, l_orderkey, l_linenumber, l_suppkey, grams, price) AS m FROM w)"""


def _addressed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    method = F.when(k % 5 == 0, "source_product_identity").when(k % 5 == 1, "canonical_storefront_handle").when(k % 5 == 2, "canonical_product_url").when(k % 5 == 3, "conservative_vendor_title_fallback").otherwise("none")
    a = table(spark, folder, "part").select(k.alias("product_id"), F.concat(F.lit("v"), k % 5).alias("vendor_id"), F.col("p_name").alias("url"), method.alias("method"), (F.col("p_size") % 4).alias("completeness"), (k % 3).cast("string").alias("collected_at"))
    i = table(spark, folder, "lineitem")
    v = i.select(
        F.col("l_partkey").alias("product_id"), F.concat(F.lit("v"), F.col("l_orderkey") % 40).alias("variant_id"), F.col("l_quantity").alias("grams"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("s"), "l_suppkey")).alias("source_variant_id"),
        F.col("l_orderkey").cast("string").alias("collected_at"), (F.col("l_linenumber") % 3).alias("filled"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("tie"),
    )
    return a, v


@query(f"WITH {_ADDRESSED} SELECT vendor_id, url, any_value(kept_id) AS product_id, any_value(candidates) AS candidates FROM s GROUP BY vendor_id, url")
def reconciled_products(spark: SparkSession, folder: str) -> DataFrame:
    """Of the products of a vendor's address the one that stays: authority, variants, completeness, freshness, identity."""
    a, v = _addressed(spark, folder)
    chosen = reconcile.selected(a, v).where("product_id = kept_id")
    return a.join(chosen, "product_id").select("vendor_id", "url", "product_id", "candidates")


@query(f"WITH {_UNITED} SELECT kept_id AS product_id, count(*) AS offered, count(*) FILTER (WHERE lost1 IS NULL AND (candidates = 1 OR m = 1)) AS kept, count(*) FILTER (WHERE lost1 = 'variant_id') AS same_id, count(*) FILTER (WHERE lost1 IS NULL AND candidates > 1 AND m > 1) AS same_weight, CAST(sum(CASE WHEN lost1 IS NULL AND (candidates = 1 OR m = 1) THEN CAST(grams AS BIGINT) END) AS BIGINT) AS grams FROM z GROUP BY kept_id")
def reconciled_variants(spark: SparkSession, folder: str) -> DataFrame:
    """All variants of those products under the one that stays, and what became of them."""
    a, v = _addressed(spark, folder)
    rows = reconcile.united(v, reconcile.selected(a, v), F.col("filled"), F.col("tie"))
    kept = F.col("lost_by").isNull()
    return rows.groupBy("product_id").agg(F.count("*").alias("offered"), F.count_if(kept).alias("kept"), F.count_if(F.col("lost_by") == "variant_id").alias("same_id"), F.count_if(F.col("lost_by") == "weight").alias("same_weight"), F.sum(F.when(kept, F.col("grams").cast("long"))).alias("grams"))
