"""What may be published: types by evidence, quantities, rejections, duplicates, public views.

Line items are turned into offers by expressions that both engines read, so that all kinds of records occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import gates, publication
from millrace.plans.registry import query
from millrace.sources.tables import table

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: A number that varies with all of an offer's keys.
_H = "(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber)"
_TEXTS = {
    "name": """concat(CASE l_orderkey % 8 WHEN 0 THEN 'THCA' WHEN 1 THEN 'Hemp' WHEN 2 THEN 'psilocybin' WHEN 3 THEN 'Magic   Mushroom' WHEN 4 THEN 'Live Resin' WHEN 5 THEN 'thc-a' WHEN 6 THEN 'Psilocybe Cubensis' ELSE 'plain' END, ' ',
 CASE l_partkey % 9 WHEN 0 THEN 'flower' WHEN 1 THEN 'Vape Pen' WHEN 2 THEN 'mushrooms' WHEN 3 THEN 'disposable' WHEN 4 THEN 'pre-roll' WHEN 5 THEN 'smalls' WHEN 6 THEN 'grinder' WHEN 7 THEN 'cartridge' ELSE 'gummies' END)""",
    "description": """concat(CASE l_suppkey % 9 WHEN 0 THEN 'bundle' WHEN 1 THEN 'with amanita' WHEN 2 THEN 'sampler-sized buds' WHEN 3 THEN 'caps and stems' WHEN 4 THEN 'total terpenes: 2.5% limonene pinene' WHEN 5 THEN '800 puffs' WHEN 6 THEN 'Potency 12%' WHEN 7 THEN 'Psilocybin: 1.5 %' ELSE '' END, ' ',
 CASE CAST(l_quantity AS BIGINT) % 10 WHEN 0 THEN '3.5g' WHEN 1 THEN '14 grams' WHEN 2 THEN '1/8 oz' WHEN 3 THEN 'quarter' WHEN 4 THEN '2 ml' WHEN 5 THEN '0.5ml 7g' WHEN 6 THEN 'half-oz' WHEN 7 THEN 'zip' WHEN 8 THEN '28 Grams' ELSE '' END)""",
    "url": "concat('https://shop.example.com/p/', l_partkey)",
    "hint": "CASE WHEN l_linenumber = 3 THEN 'hemp carts' ELSE '' END",
    "price": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END",
}


def _columns(expressions: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in expressions.items()]


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*_KEYS, *_columns(_TEXTS))


def _rule(pattern: str, column: str = "t") -> str:
    return f"regexp_matches({column}, '{pattern}', 'i')"


_S = publication.SIGNALS
_MIXED = publication.MIXED_OFFER.replace(r"samplers?(?![-\s]+sized\b)", "samplers?")  # "sampler-sized" is taken out before, as this engine looks at nothing ahead
_CLASSIFIED = f"""o AS (SELECT {", ".join(_KEYS)}, {", ".join(_columns(_TEXTS))} FROM lineitem),
x AS (SELECT *, trim(regexp_replace(concat_ws(' ', name, description, url, hint), '\\s+', ' ', 'g')) AS t FROM o),
f AS (SELECT *, {", ".join(f"{_rule(p)} AS {n}" for n, p in _S.items())}, {_rule(publication.OTHER_FORMS)} AS other_form,
 NOT {_rule(publication.ACCESSORY)} AND NOT {_rule(_MIXED, "regexp_replace(t, 'samplers?[-[:space:]]+sized', '', 'gi')")} AS usable FROM x),
g AS (SELECT *, list_filter([CASE WHEN explicit_thca AND explicit_flower AND NOT other_form THEN 'cannabis_flower' END, CASE WHEN explicit_cannabis AND explicit_vape THEN 'cannabis_vape' END,
 CASE WHEN explicit_psilocybin AND explicit_mushroom AND NOT explicit_vape AND NOT amanita_signal THEN 'psilocybin_mushroom' END, CASE WHEN explicit_psilocybin AND explicit_vape AND NOT amanita_signal THEN 'psilocybin_vape' END], lambda v: v IS NOT NULL AND usable) AS tags FROM f),
c AS (SELECT *, CASE WHEN list_contains(tags, 'psilocybin_vape') THEN 'psilocybin_vape' WHEN list_contains(tags, 'psilocybin_mushroom') THEN 'psilocybin_mushroom' WHEN list_contains(tags, 'cannabis_vape') THEN 'cannabis_vape'
 WHEN list_contains(tags, 'cannabis_flower') THEN 'cannabis_flower' END AS primary_type FROM g)"""


@query(f"WITH {_CLASSIFIED} SELECT {', '.join(_KEYS)}, primary_type, nullif(array_to_string(tags, ','), '') AS tags, explicit_thca, explicit_vape, amanita_signal FROM c")
def product_types(spark: SparkSession, folder: str) -> DataFrame:
    """A product's types by the signals of its text; accessories and offers of several things have none."""
    rows = publication.classified(_texts(spark, folder), "name", "description", "url", "hint")
    return rows.select(*_KEYS, "primary_type", F.array_join("type_tags", ",").alias("tags"), "explicit_thca", "explicit_vape", "amanita_signal")


_WEIGHED = _CLASSIFIED + r""",
w AS (SELECT *, concat(name, ' ', description) AS a FROM c WHERE primary_type IS NOT NULL),
q AS (SELECT *, regexp_extract(a, '(?i)(?:^|[^0-9])(0\.25|0\.5|1|2|3\.5|4|7|14|28|56|112)\s*(?:g|grams?)\b', 1) AS gr, regexp_extract(a, '(?i)(?:^|[^0-9])(1/8|1/4|1/2|1|2|4)(?:st|nd|rd|th)?\s*(?:(?:oz|ounces?)\b)?', 1) AS oz,
 replace(lower(regexp_extract(a, '(?i)\b(eighth|quarter|half\s+ounce|half[- ]?oz|ounce|one\s+ounce|zip)\b', 1)), '-', ' ') AS wd, regexp_extract(a, '(?i)(?:^|[^0-9])(0\.25|0\.3|0\.5|0\.8|1|1\.5|2|3|5|10)\s*(?:ml|milliliters?)\b', 1) AS ml FROM w),
v AS (SELECT *, CASE WHEN gr <> '' THEN CAST(gr AS DOUBLE) WHEN oz <> '' THEN CASE oz WHEN '1/8' THEN 3.5437 WHEN '1/4' THEN 7.0874 WHEN '1/2' THEN 14.1748 WHEN '1' THEN 28.3495 WHEN '2' THEN 56.699 ELSE 113.398 END
 WHEN wd IN ('ounce', 'one ounce', 'zip') THEN 28.3495 WHEN wd = 'eighth' THEN 3.5437 WHEN wd = 'quarter' THEN 7.0874 WHEN wd <> '' THEN 14.1748 END AS g0, CASE WHEN primary_type IN ('cannabis_vape', 'psilocybin_vape') AND ml <> '' THEN CAST(ml AS DOUBLE) END AS volume_ml FROM q),
y AS (SELECT *, CASE WHEN volume_ml IS NULL THEN CAST(g0 AS DOUBLE) END AS grams FROM v),
p AS (SELECT *, CASE WHEN grams IS NOT NULL THEN CAST(round(grams * 10000) AS HUGEINT) WHEN volume_ml IS NOT NULL THEN CAST(round(volume_ml * 10000) AS HUGEINT) END AS d, CAST(round(price * 100) AS HUGEINT) AS cents FROM y),
r AS (SELECT *, CAST((2 * cents * 1000000 + d) // (2 * d) AS DOUBLE) / 10000 AS per FROM p)"""


@query(f"""WITH {_WEIGHED} SELECT {', '.join(_KEYS)}, primary_type, grams, volume_ml, CASE WHEN grams IS NOT NULL THEN 'g' WHEN volume_ml IS NOT NULL THEN 'ml' END AS quantity_unit,
 CASE WHEN price IS NOT NULL AND d IS NOT NULL THEN CASE WHEN grams IS NOT NULL THEN 'price_per_gram' ELSE 'price_per_ml' END END AS comparison_metric, CASE WHEN price IS NOT NULL THEN per END AS comparison_price,
 CASE WHEN regexp_matches(t0, 'psilocybe cubensis', 'i') THEN 'Psilocybe Cubensis' END AS species, coalesce(CASE WHEN l_suppkey % 9 = 7 THEN 1.5 END, CASE WHEN l_suppkey % 9 = 6 THEN 12.0 END)::DOUBLE AS claimed_potency_percent,
 CASE WHEN primary_type LIKE '%vape' THEN CASE WHEN t0 ILIKE '%disposable%' THEN 'disposable' WHEN t0 ILIKE '%cartridge%' THEN 'cartridge' END END AS device_type, CASE WHEN primary_type LIKE '%vape' AND l_suppkey % 9 = 5 THEN 800 END AS puff_count,
 CASE WHEN primary_type LIKE 'cannabis%' AND l_suppkey % 9 = 4 THEN 'limonene,pinene' ELSE '' END AS terpenes, CASE WHEN primary_type LIKE 'cannabis%' AND l_suppkey % 9 = 4 THEN 2.5 END::DOUBLE AS total_terpenes_percent FROM (SELECT *, concat(name, ' ', description) AS t0 FROM r)""")
def product_records(spark: SparkSession, folder: str) -> DataFrame:
    """Generalised records: type, quantity, comparison price and what only some types have."""
    rows = publication.records(_texts(spark, folder), "name", "description", "url", "hint", "price")
    return rows.select(*_KEYS, "primary_type", "grams", "volume_ml", "quantity_unit", "comparison_metric", "comparison_price", "species", "claimed_potency_percent", "device_type", "puff_count", F.array_join("terpenes", ",").alias("terpenes"), "total_terpenes_percent")


_FIELDS = {
    "id": f"CASE WHEN {_H} % 19 = 0 THEN '' ELSE concat('id-', l_partkey, '-', l_suppkey) END", "name": f"CASE WHEN {_H} % 53 = 0 THEN ' ' WHEN {_H} % 53 = 1 THEN 'Mystery Box' ELSE concat('Item ', l_partkey) END",
    "source_id": f"CASE WHEN {_H} % 41 = 2 THEN '' ELSE concat('s', l_suppkey % 13) END", "vendor": f"CASE WHEN {_H} % 43 = 3 THEN NULL ELSE concat('V', l_suppkey % 13) END", "source_title": f"CASE WHEN {_H} % 59 = 4 THEN 'mix & match' ELSE '' END",
    "variant": "concat('v', l_linenumber)", "url": f"CASE {_H} % 37 WHEN 4 THEN 'ftp://x' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE concat('https://shop.example.com/p/', l_partkey) END",
    "public_purchase_url": f"CASE WHEN {_H} % 3 = 0 THEN concat('https://buy.example.com/', l_partkey) END", "route_url": "'https://shop.example.com/all'", "raw_url": "'x'",
    "primary_type": f"CASE {_H} % 9 WHEN 0 THEN 'cannabis_flower' WHEN 1 THEN 'cannabis_flower' WHEN 2 THEN 'cannabis_vape' WHEN 3 THEN 'cannabis_vape' WHEN 4 THEN 'cannabis_vape' WHEN 5 THEN 'psilocybin_mushroom' WHEN 6 THEN 'psilocybin_vape' WHEN 7 THEN 'psilocybin_vape' ELSE 'other' END",
    "other_type": f"CASE WHEN {_H} % 2 = 0 THEN 'cannabis_flower' ELSE 'psilocybin_vape' END", "type_kept": f"{_H} % 31 <> 7", "evidence_type": f"CASE {_H} % 61 WHEN 8 THEN 'psilocybin_mushroom' WHEN 9 THEN NULL ELSE CASE {_H} % 9 WHEN 0 THEN 'cannabis_flower' WHEN 1 THEN 'cannabis_flower' WHEN 2 THEN 'cannabis_vape' WHEN 3 THEN 'cannabis_vape' WHEN 4 THEN 'cannabis_vape' WHEN 5 THEN 'psilocybin_mushroom' WHEN 6 THEN 'psilocybin_vape' WHEN 7 THEN 'psilocybin_vape' ELSE 'other' END END",
    "evidence_source": f"CASE WHEN {_H} % 67 = 10 THEN 'product_card_title_or_url' ELSE 'detail' END", "price": f"CASE {_H} % 29 WHEN 11 THEN NULL WHEN 12 THEN 'abc' WHEN 13 THEN '-3' WHEN 14 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) * 3 AS STRING) END",
    "availability": f"CASE WHEN {_H} % 23 = 15 THEN 'unknown' ELSE 'in_stock' END", "explicit_thca": f"{_H} % 11 <> 1", "explicit_cannabis": f"{_H} % 13 <> 2", "explicit_flower": f"{_H} % 17 <> 3", "explicit_vape": f"({_H} % 9 IN (2, 3, 4, 6, 7)) = ({_H} % 10 <> 4)",
    "explicit_psilocybin": f"{_H} % 7 <> 5", "explicit_mushroom": f"{_H} % 16 <> 6", "amanita_signal": f"{_H} % 15 = 7",
    "quantity_unit": f"CASE {_H} % 14 WHEN 1 THEN 'g' WHEN 2 THEN NULL ELSE 'ml' END", "grams": f"CASE WHEN {_H} % 22 = 3 THEN 1.5 END", "volume_ml": f"CASE WHEN {_H} % 26 = 4 THEN NULL ELSE 2.0 END", "quantity_value": f"CASE {_H} % 21 WHEN 5 THEN 3.0 WHEN 6 THEN NULL ELSE 2.0 END",
    "comparison_metric": f"CASE WHEN {_H} % 25 = 6 THEN 'price_per_gram' ELSE 'price_per_ml' END", "price_per_ml": f"CASE {_H} % 27 WHEN 7 THEN NULL WHEN 8 THEN 1.0 ELSE CAST(l_quantity AS BIGINT) * 3 / CAST(2.0 AS DOUBLE) END", "comparison_price": f"CASE WHEN {_H} % 33 = 9 THEN 0.5 ELSE CAST(l_quantity AS BIGINT) * 3 / CAST(2.0 AS DOUBLE) END",
    "completeness_score": "CAST(l_quantity AS INT) % 5", "collected_at": "CAST(l_orderkey % 4 AS STRING)", "image": "CASE WHEN l_linenumber = 2 THEN 'i' END",
}
_OFFERS = f"o AS (SELECT {', '.join(_KEYS)}, {', '.join(_columns(_FIELDS))} FROM lineitem)"


def _offers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").selectExpr(*_KEYS, *_columns(_FIELDS))
    tags = F.array_compact(F.array(F.col("other_type"), F.when(F.col("type_kept"), F.col("primary_type"))))
    return rows.withColumn("type_tags", tags).drop("type_kept", "other_type")


def _volume(types: str) -> str:
    """The five quantity rules in SQL."""
    price = "TRY_CAST(price AS DOUBLE)"
    return f"""WHEN {types} AND (quantity_unit = 'g' OR grams > 0) THEN 'unsupported_vape_mass_quantity' WHEN {types} AND (quantity_unit IS DISTINCT FROM 'ml' OR volume_ml IS NULL) THEN 'missing_vape_volume'
 WHEN {types} AND abs(quantity_value - volume_ml) > 0.0001 THEN 'inconsistent_vape_quantity' WHEN {types} AND (comparison_metric <> 'price_per_ml' OR comparison_price IS NULL OR price_per_ml IS NULL) THEN 'missing_vape_comparison_price'
 WHEN {types} AND (abs(comparison_price - price_per_ml) > 0.0001 OR abs(price_per_ml - {price} / volume_ml) > 0.0001) THEN 'inconsistent_vape_comparison_price'"""


_REASON = f"""CASE WHEN evidence_source = 'product_card_title_or_url' THEN 'unverified_listing_card_evidence' WHEN trim(name) = '' THEN 'missing_name' WHEN source_id = '' OR vendor IS NULL THEN 'missing_source_identity' WHEN name = 'Mystery Box' OR source_title <> '' THEN 'unsupported_mixed_offer'
 WHEN coalesce(url, '') NOT LIKE 'http%' THEN 'missing_or_invalid_internal_product_url' WHEN primary_type = 'other' THEN 'unsupported_or_missing_primary_type' WHEN NOT type_kept AND other_type <> primary_type THEN 'primary_type_missing_from_type_tags' WHEN evidence_type IS DISTINCT FROM primary_type THEN 'classification_evidence_type_mismatch'
 WHEN coalesce(price, '') = '' THEN 'missing_current_price' WHEN price IN ('abc', '-3') OR TRY_CAST(price AS DOUBLE) <= 0 THEN 'invalid_current_price' WHEN availability <> 'in_stock' THEN 'not_explicitly_in_stock'
 WHEN primary_type = 'cannabis_flower' THEN CASE WHEN NOT explicit_thca THEN 'missing_product_level_thca_evidence' WHEN NOT explicit_flower THEN 'missing_product_level_flower_evidence' WHEN explicit_vape THEN 'flower_vape_contamination' END
 WHEN primary_type = 'psilocybin_mushroom' THEN CASE WHEN NOT explicit_psilocybin THEN 'missing_product_level_psilocybin_evidence' WHEN NOT explicit_mushroom THEN 'missing_product_level_mushroom_evidence' WHEN explicit_vape THEN 'mushroom_vape_contamination' WHEN amanita_signal THEN 'amanita_not_psilocybin' END
 WHEN primary_type = 'cannabis_vape' AND NOT explicit_cannabis THEN 'missing_product_level_cannabis_evidence' WHEN primary_type = 'psilocybin_vape' AND NOT explicit_psilocybin THEN 'missing_product_level_psilocybin_evidence' WHEN NOT explicit_vape THEN 'missing_product_level_vape_evidence'
 WHEN primary_type = 'psilocybin_vape' AND amanita_signal THEN 'amanita_not_psilocybin' {_volume("true")} END"""


@query(f"WITH {_OFFERS} SELECT {', '.join(_KEYS)}, {_REASON} AS reason FROM o")
def reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Of every offer the first of all rejections that holds, or none."""
    return _offers(spark, folder).select(*_KEYS, gates.first_failing(publication.reject_rules()).alias("reason"))


@query(f"WITH {_OFFERS} SELECT reason, count(*) AS rows FROM (SELECT {_REASON} AS reason FROM o) WHERE reason IS NOT NULL GROUP BY reason")
def rejections_by_reason(spark: SparkSession, folder: str) -> DataFrame:
    return gates.reason_counts(gates.split(_offers(spark, folder), publication.reject_rules())[1])


@query(f"""WITH {_OFFERS} SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN coalesce(url, '') = '' THEN 'missing_product_url' WHEN evidence_type IS NULL THEN 'missing_classification_evidence' WHEN primary_type <> evidence_type THEN 'classification_type_mismatch'
 WHEN evidence_source = 'product_card_title_or_url' THEN 'unverified_listing_card_evidence' END AS reason FROM o) WHERE reason IS NOT NULL GROUP BY reason""")
def strict_gate_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """What is taken out before the source's gate, as that would refuse it."""
    return gates.reason_counts(gates.split(_offers(spark, folder), publication.strict_rules())[1])


@query(f"WITH {_OFFERS} SELECT source_id, count(*) AS rows FROM o WHERE evidence_type = primary_type GROUP BY source_id")
def consistent_rows(spark: SparkSession, folder: str) -> DataFrame:
    return publication.consistent(_offers(spark, folder)).groupBy("source_id").agg(F.count("*").alias("rows"))


@query(f"""WITH {_OFFERS}, n AS (SELECT source_id, count(*) AS products, count(*) FILTER (WHERE coalesce(url, '') <> '') AS urls, count(*) FILTER (WHERE TRY_CAST(price AS DOUBLE) > 0) AS priced_products,
 count(*) FILTER (WHERE evidence_type = primary_type AND primary_type <> 'other') AS evidenced_products, count(*) FILTER (WHERE evidence_source LIKE 'product_card%') AS unverified_listing_cards FROM o GROUP BY source_id)
SELECT source_id, products, CAST(((2 * urls * 10000 + products) // (2 * products)) AS DOUBLE) / 10000 AS url_coverage, priced_products, evidenced_products, unverified_listing_cards,
 array_to_string(list_filter([CASE WHEN urls < 0.9 * products THEN 'insufficient_product_urls' END, CASE WHEN priced_products = 0 THEN 'no_priced_products' END, CASE WHEN evidenced_products <> products THEN 'missing_product_level_evidence' END,
 CASE WHEN unverified_listing_cards > 0 THEN 'unverified_listing_card_evidence' END], lambda v: v IS NOT NULL), ',') AS reasons FROM n""")
def source_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements of each source and what they say against it."""
    rows = publication.source_quality(_offers(spark, folder), "source_id")
    return rows.select("source_id", "products", "url_coverage", "priced_products", "evidenced_products", "unverified_listing_cards", F.array_join("reasons", ",").alias("reasons"))


_SCORE = "(price IS NOT NULL AND price <> '')::INT + (grams IS NOT NULL)::INT + (volume_ml IS NOT NULL)::INT + (price_per_ml IS NOT NULL)::INT + (image IS NOT NULL)::INT + (evidence_type IS NOT NULL)::INT"
_IDENTITY = "CASE WHEN id <> '' THEN id ELSE concat_ws('|', source_id, primary_type, lower(trim(name)), variant, lower(coalesce(url, ''))) END"


@query(f"""WITH {_OFFERS} SELECT {', '.join(_KEYS)}, identity FROM (SELECT *, {_IDENTITY} AS identity, {_SCORE} AS score FROM o)
 QUALIFY row_number() OVER (PARTITION BY identity ORDER BY score DESC, completeness_score DESC, collected_at DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1""")
def publication_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """One offer an identity: the fullest, most complete, latest."""
    rows = publication.deduplicated(_offers(spark, folder), F.struct(*_KEYS))
    return rows.select(*_KEYS, publication.identity_key().alias("identity"))


@query(f"""WITH {_OFFERS} SELECT {', '.join(_KEYS)}, CASE WHEN primary_type LIKE 'psilocybin%' THEN '' ELSE coalesce(public_purchase_url, url, '') END AS url, CASE WHEN primary_type NOT LIKE 'psilocybin%' THEN coalesce(public_purchase_url, url, '') END AS public_purchase_url,
 CASE WHEN primary_type LIKE 'psilocybin%' THEN '' ELSE route_url END AS route_url, primary_type NOT LIKE 'psilocybin%' AS permits_public_purchase_link,
 array_to_string(list_filter(['cannabis_flower', 'cannabis_vape', 'psilocybin_mushroom', 'psilocybin_vape', 'other'], lambda v: v = other_type OR (type_kept AND v = primary_type)), ',') AS type_tags FROM o""")
def public_products(spark: SparkSession, folder: str) -> DataFrame:
    """Links of controlled types hidden, tags in the types' order, raw addresses gone."""
    rows = publication.public_view(_offers(spark, folder))
    assert "raw_url" not in rows.columns
    return rows.select(*_KEYS, "url", "public_purchase_url", "route_url", "permits_public_purchase_link", F.array_join("type_tags", ",").alias("type_tags"))


@query(f"""WITH {_OFFERS}, a AS (SELECT * FROM (SELECT *, {_REASON} AS reason FROM o) WHERE reason IS NULL)
SELECT 'controlled_links' AS "check", CAST(0 AS BIGINT) AS measured, true AS passed UNION ALL SELECT 'active_sources', count(DISTINCT source_id), count(DISTINCT source_id) >= 10 FROM a UNION ALL SELECT 'products', count(*), count(*) >= 1000000000 FROM a""")
def publication_floors(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the public rows as a whole."""
    admitted = gates.split(_offers(spark, folder), publication.reject_rules())[0]
    return publication.floors(publication.public_view(admitted), "source_id", 10, 1_000_000_000)


@query(f"""WITH {_OFFERS} SELECT {', '.join(_KEYS)}, CAST(round_even(((name IS NOT NULL AND name <> '')::INT + (vendor IS NOT NULL)::INT + (coalesce(price, '') <> '')::INT + 1 + (image IS NOT NULL)::INT) * 7.0
 + CASE primary_type WHEN 'cannabis_flower' THEN (grams IS NOT NULL)::INT * 9.0 WHEN 'cannabis_vape' THEN ((volume_ml IS NOT NULL)::INT + (price_per_ml IS NOT NULL)::INT) * 11.25 WHEN 'psilocybin_mushroom' THEN (grams IS NOT NULL)::INT * 9.0
 WHEN 'psilocybin_vape' THEN ((volume_ml IS NOT NULL)::INT + (price_per_ml IS NOT NULL)::INT) * 11.25 ELSE 0 END + CASE WHEN evidence_type = primary_type THEN 20 ELSE 0 END, 0) AS INTEGER) AS score FROM o""")
def type_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """How complete a record of its type is, 0 to 100."""
    rows = _offers(spark, folder)
    return rows.select(*_KEYS, publication.completeness(rows, "primary_type", "evidence_type").alias("score"))
