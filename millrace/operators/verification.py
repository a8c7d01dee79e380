"""Whole-dataset assertions: every check gives the rows that break it, as (check, key); all is well if there are none.

Checks of single rows are made in one pass over their table; others by grouping or joining on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import within
from millrace.functions.text import column
from millrace.operators import gates, publication
from millrace.operators.matching import parity
from millrace.operators.ranking import best_row

#: Lineages, document scopes, and those of them that name a variant.
LINEAGES = ["indica", "indica_leaning_hybrid", "hybrid", "sativa_leaning_hybrid", "sativa", "unknown"]
SCOPES, NARROW = ["variant", "weight", "batch", "product", "vendor"], ["variant", "weight", "batch"]
#: Tolerances of a unit price, a discount, a weight between tables, a document's weight.
PRICE_OFF, DISCOUNT_OFF, WEIGHT_OFF, DOCUMENT_OFF = 0.001, 0.02, 0.0001, 0.01


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_checks(df: DataFrame, key: Column, rules: gates.Rules) -> DataFrame:
    """(check, key) of all rules that hold, in one pass."""
    return df.select(F.explode(gates.all_failing(rules)).alias("check"), key.cast("string").alias("key"))


def repeated(df: DataFrame, check: str, *keys: str) -> DataFrame:
    """Keys of more than one row, or without a value."""
    known = [column(k) for k in keys]
    rows = df.groupBy(*(k.alias(f"k{i}") for i, k in enumerate(known))).agg(F.count("*").alias("n"))
    return rows.where((F.col("n") > 1) | (F.col(f"k{len(known) - 1}") == "")).select(F.lit(check).alias("check"), F.concat_ws("|", *(f"k{i}" for i in range(len(known)))).alias("key"))


def active_variants(variants: DataFrame) -> DataFrame:
    """Each product's variant in stock of least unit price, price, weight and id."""
    return best_row(variants.where("in_stock"), ["product_id"], [F.asc("price_per_gram"), F.asc("current_price"), F.asc("grams"), F.asc("variant_id")])


def index_checks(products: DataFrame, variants: DataFrame) -> DataFrame:
    """The compact index. products: product_id, vendor_id, vendor_name, strain_name, lineage, rating, review_count,
    default_variant_id; variants: product_id, variant_id, in_stock, grams, current_price, price_per_gram, original_price,
    discount_percent."""
    blank = lambda c: F.trim(column(c)) == ""
    price, grams, original, discount = (F.col(c) for c in ("current_price", "grams", "original_price", "discount_percent"))
    inconsistent = ~F.coalesce((grams > 0) & (price > 0) & (F.abs(price / grams - F.col("price_per_gram")) <= PRICE_OFF), F.lit(False))
    expected = (original - price) / original * 100
    weights = variants.groupBy("product_id", F.round("grams", 4).alias("g")).agg(F.count("*").alias("n")).where("n > 1")
    chosen = active_variants(variants).select("product_id", F.col("variant_id").alias("active"))
    wrong = products.join(chosen, "product_id").where(~F.col("default_variant_id").eqNullSafe(F.col("active")))
    return _all([
        row_checks(products, F.col("product_id"), [
            ("missing_vendor_id", blank("vendor_id")), ("missing_vendor_name", blank("vendor_name")), ("missing_strain_name", blank("strain_name")),
            ("invalid_lineage", ~F.coalesce(F.col("lineage").isin(LINEAGES), F.lit(False))), ("rating_nullability", F.col("rating").isNull() != F.col("review_count").isNull()),
        ]),
        row_checks(variants, F.col("variant_id"), [
            ("not_in_stock", ~F.coalesce(F.col("in_stock"), F.lit(False))), ("pricing_inconsistency", inconsistent), ("invalid_original_price", original <= price),
            ("discount_inconsistency", (original > price) & ~F.coalesce(F.abs(expected - discount) <= DISCOUNT_OFF, F.lit(False))), ("discount_without_original", original.isNull() & discount.isNotNull()),
        ]),
        repeated(products, "product_id_not_unique", "product_id"), repeated(variants, "variant_id_not_unique", "variant_id"),
        weights.select(F.lit("weight_not_unique").alias("check"), F.concat_ws("|", "product_id", F.format_number("g", 4)).alias("key")),
        products.join(variants.select("product_id").distinct(), "product_id", "left_anti").select(F.lit("product_without_variants").alias("check"), F.col("product_id").alias("key")),
        wrong.select(F.lit("default_variant_mismatch").alias("check"), F.col("product_id").alias("key")),
    ])


def parity_checks(products: DataFrame, variants: DataFrame, details: DataFrame, detail_variants: DataFrame) -> DataFrame:
    """Index and details hold the same products and variants, of the same weights and addresses; a vendor's address is of
    one product."""
    one = parity(products, details, "product_id").select(F.concat(F.lit("product_"), "side").alias("check"), F.col("product_id").cast("string").alias("key"))
    two = parity(variants, detail_variants, "variant_id").select(F.concat(F.lit("variant_"), "side").alias("check"), F.col("variant_id").alias("key"))
    both = variants.select("variant_id", "grams", "url").join(detail_variants.select("variant_id", F.col("grams").alias("g"), F.col("url").alias("u")), "variant_id")
    off = row_checks(both, F.col("variant_id"), [("weight_mismatch", F.abs(F.col("grams") - F.col("g")) > WEIGHT_OFF), ("url_mismatch", ~F.col("url").eqNullSafe(F.col("u")))])
    return _all([one, two, off, repeated(details, "product_url_not_unique", "vendor_id", "canonical_product_url")])


def document_checks(documents: DataFrame, variants: DataFrame) -> DataFrame:
    """Documents (document_id, held_product_id, held_variant_id, held_vendor_id, and their own product_id, vendor_id, scope,
    variant_id, source_variant_id, grams, batch, lot) on the variants (variant_id, source_variant_id, grams, batch, lot) that
    hold them."""
    v = variants.select(F.col("variant_id").alias("held_variant_id"), *(F.col(c).alias(f"v_{c}") for c in ("source_variant_id", "grams", "batch", "lot")))
    rows = documents.join(v, "held_variant_id", "left")
    scope, narrow = column("scope"), column("scope").isin(NARROW)

    def batches(*names: str) -> Column:
        return F.filter(F.array(*(F.lower(F.trim(column(n))) for n in names)), lambda b: b != "")

    named = column("source_variant_id")
    return row_checks(rows, F.concat_ws("|", "document_id", "held_variant_id"), [
        ("document_vendor_mismatch", column("vendor_id") != column("held_vendor_id")), ("document_product_mismatch", column("product_id") != column("held_product_id")), ("document_invalid_scope", ~scope.isin(SCOPES)),
        ("document_variant_mismatch", narrow & (column("variant_id") != column("held_variant_id"))), ("broad_document_has_variant", scope.isin("product", "vendor") & (column("variant_id") != "")),
        ("document_source_variant_mismatch", (scope == "variant") & ((named == "") | ((named != column("held_variant_id")) & (named != column("v_source_variant_id"))))),
        ("document_weight_missing", (scope == "weight") & (F.col("grams").isNull() | F.col("v_grams").isNull())), ("document_weight_mismatch", (scope == "weight") & (F.abs(F.col("grams") - F.col("v_grams")) > DOCUMENT_OFF)),
        ("document_batch_mismatch", (scope == "batch") & ~F.arrays_overlap(batches("batch", "lot"), batches("v_batch", "v_lot"))),
    ])


def rating_checks(details: DataFrame, index: DataFrame) -> DataFrame:
    """A rating's origin: none for none, else one record's pair with its values. details: product_id, provenance_source,
    provenance_method, raw_score, raw_count, source_record_id, source_path, collected_at."""
    rows = details.join(index.select("product_id", "rating", "review_count"), "product_id")
    rated = F.col("rating").isNotNull()
    lost = [(f"rating_without_{c}", rated & (F.trim(column(c)) == "")) for c in ("source_record_id", "source_path", "collected_at")]
    return row_checks(rows, F.col("product_id"), [
        ("unrated_with_origin", ~rated & (column("provenance_source") != "unavailable")), ("rating_not_atomic", rated & (column("provenance_method") != "atomic_source_record_pair")),
        ("rating_value_mismatch", rated & ~(F.col("raw_score").eqNullSafe(F.col("rating")) & F.col("raw_count").eqNullSafe(F.col("review_count")))), *lost,
    ])


def count_checks(declared: dict[str, int], counted: dict[str, DataFrame]) -> DataFrame:
    """(check, key) of declared counts that are not the tables' own."""
    own = _all([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(declared[name]).cast("long").alias("declared")) for name, df in counted.items()])
    return own.where("n <> declared").select(F.concat("name", F.lit("_count_mismatch")).alias("check"), F.concat_ws("|", "declared", "n").alias("key"))


def file_checks(declared: DataFrame, found: DataFrame, most_bytes: int) -> DataFrame:
    """Declared files (path, sha256, bytes) against those found (path, content)."""
    rows = declared.join(found.select("path", F.sha2("content", 256).alias("own_sha256"), F.octet_length("content").alias("own_bytes")), "path", "left")
    return row_checks(rows, F.col("path"), [
        ("file_missing", F.col("own_sha256").isNull()), ("file_hash_mismatch", F.col("own_sha256") != F.col("sha256")), ("file_bytes_mismatch", F.col("own_bytes") != F.col("bytes")), ("file_too_large", F.col("own_bytes") > most_bytes),
    ])


def type_checks(df: DataFrame, key: Column) -> DataFrame:
    """Published rows have evidence of their type, and controlled ones no links."""
    p, s = column("primary_type"), {k: F.coalesce(F.col(k), F.lit(False)) for k in publication.SIGNALS}
    valid = (
        F.when(p == publication.FLOWER, s["explicit_thca"] & s["explicit_flower"]).when(p == publication.VAPE, s["explicit_cannabis"] & s["explicit_vape"])
        .when(p == publication.MUSHROOM, s["explicit_psilocybin"] & s["explicit_mushroom"] & ~s["explicit_vape"] & ~s["amanita_signal"])
        .when(p == publication.MUSHROOM_VAPE, s["explicit_psilocybin"] & s["explicit_vape"] & ~s["amanita_signal"]).otherwise(F.lit(False))
    )
    links = reduce(lambda a, b: a | b, [column(c) != "" for c in ("url", "public_purchase_url", "route_url") if c in df.columns])
    return row_checks(df, key, [("invalid_type_evidence", ~valid), ("controlled_link", p.isin(publication.CONTROLLED) & links)])


#: How labels name mass and volume, and the reasons of quantity rejections.
MASS_LABEL, VOLUME_LABEL = r"(?i)\d\s*(?:g|grams?|mg)\b", r"(?i)\d\s*(?:ml|milliliters?)\b"
QUANTITY_REASONS = ["unsupported_vape_mass_quantity", "missing_vape_volume", "inconsistent_vape_quantity", "missing_vape_comparison_price", "inconsistent_vape_comparison_price"]


def quantity_checks(published: DataFrame, rejected: DataFrame, key: Column, labels: Column) -> DataFrame:
    """Published rows sold by volume pass all quantity rules; rejected ones name a known reason that fits their label."""
    vape = F.col("primary_type").isin(publication.VAPE, publication.MUSHROOM_VAPE)
    mass, volume, reason = labels.rlike(MASS_LABEL), labels.rlike(VOLUME_LABEL), column("reason")
    return _all([
        row_checks(published.where(vape), key, publication.volume_rules(F.lit(True))),
        row_checks(rejected, key, [
            ("mass_only_with_other_reason", vape & mass & ~volume & (reason != "unsupported_vape_mass_quantity")), ("unknown_quantity_reason", reason.rlike("^(?:unsupported|missing|inconsistent)_vape_") & ~reason.isin(QUANTITY_REASONS)),
            ("mass_reason_without_label", (reason == "unsupported_vape_mass_quantity") & ~mass),
        ]),
    ])


def shard_checks(shards: DataFrame, commit: str, schema: str) -> DataFrame:
    """Shard files (file, schema_version, source_commit): one commit, known schema, numbered names, each number once."""
    rows = shards.withColumn("number", F.regexp_extract("file", r"shard-(\d+)\.json$", 1))
    return _all([
        row_checks(rows, F.col("file"), [
            ("shard_schema", column("schema_version") != schema), ("shard_name", F.col("number") == ""), ("shard_commit_form", ~column("source_commit").rlike("^[0-9a-f]{40}$")), ("shard_commit_mismatch", column("source_commit") != commit),
        ]),
        rows.where("number <> ''").groupBy(F.col("number").cast("long").alias("n")).agg(F.count("*").alias("files")).where("files > 1").select(F.lit("shard_number_not_unique").alias("check"), F.col("n").cast("string").alias("key")),
    ])


def registry_checks(vendors: DataFrame, routes: DataFrame, least: int, types: list[str]) -> DataFrame:
    """A registry of vendors (vendor_id, vendor_name, classification, display) and routes (vendor_id, type, url, scope)."""
    few = vendors.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit("too_few_vendors").alias("check"), F.col("n").cast("string").alias("key"))
    return _all([
        few, repeated(vendors, "vendor_id_not_unique", "vendor_id"),
        row_checks(vendors, F.col("vendor_id"), [("vendor_without_name", F.trim(column("vendor_name")) == ""), ("age_check_missing", (column("classification") == "") | (column("display") == ""))]),
        vendors.join(routes.select("vendor_id").distinct(), "vendor_id", "left_anti").select(F.lit("routes_missing").alias("check"), F.col("vendor_id").cast("string").alias("key")),
        row_checks(routes, F.concat_ws("|", "vendor_id", "url"), [("route_type", ~F.coalesce(F.col("type").isin(types), F.lit(False))), ("route_not_https", ~column("url").startswith("https://")), ("route_without_scope", column("scope") == "")]),
    ])


def cached_state(df: DataFrame, generation: str, now: Column, most_age: int = 1800, most_ahead: int = 60) -> DataFrame:
    """Adds code: why a cached generation may not be used, or ok. Columns: generation_id, schema_ok, hash_ok, complete,
    cached_at, generated_at."""
    age = now.cast("long") - F.least(F.col("cached_at"), F.col("generated_at")).cast("long")
    ahead = F.greatest(F.col("cached_at"), F.col("generated_at")).cast("long") - now.cast("long")
    rules = [
        ("missing", F.col("generation_id").isNull()), ("schema", ~F.coalesce(F.col("schema_ok"), F.lit(False))), ("incomplete", ~F.coalesce(F.col("complete"), F.lit(False))), ("generation", F.col("generation_id") != generation),
        ("hash", ~F.coalesce(F.col("hash_ok"), F.lit(False))), ("future", ahead > most_ahead), ("expired", ~F.coalesce(within(age, None, most_age), F.lit(False))),
    ]
    return df.withColumn("code", F.coalesce(gates.first_failing(rules), F.lit("ok")))


def cached_generation(df: DataFrame, now: Column, most_age: int = 1800, most_ahead: int = 60, there: Column | None = None) -> DataFrame:
    """Adds code, the first of the fixed codes by which a cached generation is refused or "valid", and accepted: whether it is
    valid and young enough. Columns: corruption_code, generation_id, manifest (struct with schema_ok and generation_id), index
    (struct with generation_id, product_count and products, an array of structs with product_id and variants), cached_at,
    generated_at. A null value is a missing one. there: whether a row holds a value at all, which may lack every part; without
    it, a row whose corruption_code, generation_id, manifest and index are all null is no value.

    Of the products the first that breaks a rule decides. Young: neither time lies more than most_ahead seconds ahead, and the
    older one at most most_age seconds back and not ahead."""
    own, manifest, index = F.trim(F.coalesce("generation_id", F.lit(""))), F.col("manifest"), F.col("index")
    no_id = lambda p: p.isNull() | (F.trim(F.coalesce(p["product_id"], F.lit(""))) == "")
    broken = F.get(F.filter(F.transform(index["products"], lambda p: F.when(no_id(p), "cache_product_invalid").when(p["variants"].isNull(), "cache_variants_invalid")), lambda c: c.isNotNull()), F.lit(0))
    false = F.lit(False)
    empty = F.col("generation_id").isNull() & manifest.isNull() & index.isNull() & F.col("corruption_code").isNull()
    absent = empty if there is None else ~F.coalesce(there, false)
    rules = [
        ("cache_value_invalid", absent), (None, F.col("corruption_code").isNotNull()),
        ("cache_generation_id_missing", own == ""), ("cache_manifest_invalid", ~F.coalesce(manifest["schema_ok"], false)), ("cache_generation_mismatch", ~F.coalesce(manifest["generation_id"] == own, false)),
        ("cache_index_invalid", index.isNull()), ("cache_generation_mismatch", ~F.coalesce(index["generation_id"] == own, false)), ("cache_products_invalid", index["products"].isNull()),
        ("cache_product_count_mismatch", F.coalesce(index["product_count"] != F.size(index["products"]), false)), (broken, broken.isNotNull()),
    ]
    code = F.lit("valid")
    for name, hit in reversed(rules):
        code = F.when(hit, F.col("corruption_code") if name is None else F.lit(name) if isinstance(name, str) else name).otherwise(code)
    at = [F.col(c).cast("long") for c in ("cached_at", "generated_at")]
    age = now.cast("long") - F.least(*at)
    young = at[0].isNotNull() & at[1].isNotNull() & (F.greatest(*at) <= now.cast("long") + most_ahead) & age.between(0, most_age)
    return df.withColumn("code", code).withColumn("accepted", (F.col("code") == "valid") & F.coalesce(young, false))
