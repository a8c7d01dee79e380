"""From classified records to what may be published: product types by evidence, quantities, ordered rejections, public views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.extract import lookup
from millrace.functions.text import column
from millrace.operators import gates

# Product types, in order, and those whose links are never shown.
FLOWER, VAPE, MUSHROOM, MUSHROOM_VAPE = "cannabis_flower", "cannabis_vape", "psilocybin_mushroom", "psilocybin_vape"
TYPES = [FLOWER, VAPE, MUSHROOM, MUSHROOM_VAPE]
CONTROLLED = [MUSHROOM, MUSHROOM_VAPE]
#: Which type counts where a product has several.
PRIORITY = [MUSHROOM_VAPE, MUSHROOM, VAPE, FLOWER]

# The signals of a product's text.
SIGNALS = {
    "explicit_thca": r"\b(?:thca|thc-a|high\s+thca|type\s+[i1])\b",
    "explicit_cannabis": r"\b(?:cannabis|hemp|marijuana|thca|thc-a|delta[- ]?9|delta[- ]?8|live\s+resin|live\s+rosin|distillate|cannabinoid)\b",
    "explicit_flower": r"\b(?:flower|buds?|smalls|minis|popcorn|shake|trim)\b",
    "explicit_vape": r"\b(?:vapes?|cartridges?|carts?|disposables?|all[- ]?in[- ]?one|510(?:\s+thread(?:ed)?)?|pods?|vape\s+pens?)\b",
    "explicit_psilocybin": r"\b(?:psilocybin|psilocin|magic\s+mushrooms?|psychedelic\s+mushrooms?|psilocybe(?:\s+(?:cubensis|natalensis|cyanescens|semilanceata|azurescens))?)\b",
    "explicit_mushroom": r"\b(?:mushrooms?|shrooms?|fruiting\s+bodies|caps?\s+and\s+stems?)\b",
    "amanita_signal": r"\b(?:amanita|muscaria|muscimol|ibotenic)\b",
}
# What is no product of these types, offers of several things, and forms that are no flower.
ACCESSORY = r"\b(?:battery|charger|empty\s+cart|replacement\s+coil|atomizer|glass|grinder|tray|apparel|shirt|hoodie|hat|poster|gift\s*card|subscription|wholesale|display\s+case|storage\s+jar)\b"
MIXED_OFFER = r"\b(?:bundles?|samplers?(?![-\s]+sized\b)|sample\s+packs?|variety\s+packs?|stash\s+kits?|mystery\s+(?:box(?:es)?|bags?|packs?)|mix(?:\s*&\s*|[-\s]+and[-\s]+|[-\s]+)match)\b"
OTHER_FORMS = r"\b(?:pre[- ]?rolls?|prerolls?|joints?|blunts?|cones?|vapes?|cartridges?|carts?|disposables?|gumm(?:y|ies)|edibles?|tinctures?|capsules?|beverages?|concentrates?|rosin|resin|badder|budder|crumble|isolate|dabs?|wax|seeds?|clones?)\b"

# Quantities in labels.
GRAM = r"(?i)(?<!\d)(0\.25|0\.5|1|2|3\.5|4|7|14|28|56|112)\s*(?:g|grams?)\b"
OUNCE = r"(?i)(?<!\d)(1/8|1/4|1/2|1|2|4)(?:st|nd|rd|th)?\s*(?:(?:oz|ounces?)\b)?"
WORD_WEIGHT = r"(?i)\b(eighth|quarter|half\s+ounce|half[- ]?oz|ounce|one\s+ounce|zip)\b"
MILLILITRES = r"(?i)(?<!\d)(0\.25|0\.3|0\.5|0\.8|1|1\.5|2|3|5|10)\s*(?:ml|milliliters?)\b"
OUNCE_GRAMS = {"1/8": 3.5437, "1/4": 7.0874, "1/2": 14.1748, "1": 28.3495, "2": 56.699, "4": 113.398}
WORD_GRAMS = {"eighth": 3.5437, "quarter": 7.0874, "half ounce": 14.1748, "half oz": 14.1748, "ounce": 28.3495, "one ounce": 28.3495, "zip": 28.3495}

# Type-specific fields.
SPECIES = r"(?i)\b(psilocybe\s+(?:cubensis|natalensis|cyanescens|semilanceata|azurescens))\b"
PSILOCYBIN_PERCENT = r"(?i)\bpsilocybin\s*[:\-]?\s*(\d{1,2}(?:\.\d+)?)\s*%"
POTENCY_PERCENT = r"(?i)\bpotency\s*[:\-]?\s*(\d{1,2}(?:\.\d+)?)\s*%"
TERPENE_TOTAL = r"(?i)\btotal\s+terpenes?\s*[:\-]?\s*(\d{1,2}(?:\.\d+)?)\s*%"
PUFFS = r"(?i)\b(\d{2,5})\s*(?:puffs?|draws?)\b"
DEVICES = [("disposable", "disposable"), ("cartridge", "cartridge"), (" cart ", "cartridge"), ("pod", "pod"), ("510", "510 cartridge"), ("all-in-one", "all-in-one")]
TERPENES = ["myrcene", "limonene", "caryophyllene", "linalool", "pinene", "humulene", "terpinolene", "ocimene", "bisabolol"]
#: The fields that a complete record of each type has.
TYPE_FIELDS = {
    FLOWER: ["grams", "thca", "lineage", "terpenes", "price_per_gram"], VAPE: ["volume_ml", "device_type", "terpenes", "price_per_ml"],
    MUSHROOM: ["species", "strain", "grams", "claimed_potency_percent", "price_per_gram"], MUSHROOM_VAPE: ["volume_ml", "device_type", "psilocybin_percent", "price_per_ml"],
}
COMMON_FIELDS = ["name", "vendor", "price", "availability", "image"]
#: How far a price may lie from what its quantity gives.
TOLERANCE = 1e-4


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def one_text(*parts: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(" ", *(column(p) for p in parts)), r"\s+", " "))


def classified(df: DataFrame, name: str, description: str, url: str, hint: str) -> DataFrame:
    """Adds the signals, type_tags (in order of TYPES) and primary_type; both null for accessories, offers of several
    things, and texts without evidence of a type."""
    rows = df.withColumn("__text", one_text(name, description, url, hint)).withColumn("__offer", one_text(name, description, url))
    rows = rows.withColumns({signal: has(F.col("__text"), pattern) for signal, pattern in SIGNALS.items()})
    s = {k: F.col(k) for k in SIGNALS}
    flags = [
        (FLOWER, s["explicit_thca"] & s["explicit_flower"] & ~has(F.col("__text"), OTHER_FORMS)), (VAPE, s["explicit_cannabis"] & s["explicit_vape"]),
        (MUSHROOM, s["explicit_psilocybin"] & s["explicit_mushroom"] & ~s["explicit_vape"] & ~s["amanita_signal"]), (MUSHROOM_VAPE, s["explicit_psilocybin"] & s["explicit_vape"] & ~s["amanita_signal"]),
    ]
    usable = (F.col("__text") != "") & ~has(F.col("__text"), ACCESSORY) & ~has(F.col("__offer"), MIXED_OFFER)
    rows = rows.withColumns({f"__{t}": flag & usable for t, flag in flags})
    tags = F.array_compact(F.array(*(F.when(F.col(f"__{t}"), F.lit(t)) for t in TYPES)))
    primary = F.coalesce(*(F.when(F.col(f"__{t}"), F.lit(t)) for t in PRIORITY))
    rows = rows.withColumns({"type_tags": F.when(F.size(tags) > 0, tags), "primary_type": primary})
    return rows.drop("__text", "__offer", *(f"__{t}" for t in TYPES))


def quantities(df: DataFrame, text: str, primary: str) -> DataFrame:
    """Adds grams, volume_ml, quantity_value and quantity_unit from a label. Volume beats mass where the type is sold by
    volume, and counts for no other."""
    grams = F.regexp_extract(text, GRAM, 1)
    ounces, word = F.regexp_extract(text, OUNCE, 1), F.regexp_replace(F.lower(F.regexp_extract(text, WORD_WEIGHT, 1)), r"[\s-]+", " ")
    rows = df.withColumn("__g", F.when(grams != "", grams.try_cast("double")).when(ounces != "", lookup(ounces, OUNCE_GRAMS)).otherwise(lookup(word, WORD_GRAMS)))
    by_volume = F.col(primary).isin(VAPE, MUSHROOM_VAPE)
    rows = rows.withColumn("volume_ml", F.when(~F.coalesce(F.col(primary).isin(FLOWER, MUSHROOM), F.lit(False)), F.regexp_extract(text, MILLILITRES, 1).try_cast("double")))
    rows = rows.withColumn("grams", F.when(~(F.coalesce(by_volume, F.lit(False)) & F.col("volume_ml").isNotNull()), F.col("__g"))).drop("__g")
    unit = F.when(F.col("grams").isNotNull(), "g").when(F.col("volume_ml").isNotNull(), "ml")
    return rows.withColumns({"quantity_value": F.coalesce("grams", "volume_ml"), "quantity_unit": unit})


def compared(df: DataFrame, price: str) -> DataFrame:
    """Adds comparison_metric, comparison_price, price_per_gram and price_per_ml: a price by its quantity, to 4 places."""
    p = F.when(F.col(price) > 0, F.col(price).cast("decimal(18,4)"))
    per = {unit: F.when(F.col(q) > 0, F.round(p / F.col(q).cast("decimal(18,4)"), 4).cast("double")) for unit, q in (("gram", "grams"), ("ml", "volume_ml"))}
    rows = df.withColumns({"price_per_gram": per["gram"], "__ml": per["ml"]})
    rows = rows.withColumn("price_per_ml", F.when(F.col("grams").isNull(), F.col("__ml"))).drop("__ml")
    metric = F.when(F.col("price_per_gram").isNotNull(), "price_per_gram").when(F.col("price_per_ml").isNotNull(), "price_per_ml")
    return rows.withColumns({"comparison_metric": metric, "comparison_price": F.coalesce("price_per_gram", "price_per_ml")})


def type_fields(df: DataFrame, text: str, primary: str) -> DataFrame:
    """Adds species, claimed_potency_percent, psilocybin_percent, device_type, puff_count, terpenes and
    total_terpenes_percent, each where the type has it."""
    df = df.withColumn("__t", one_text(text)).withColumn("__low", F.concat(F.lit(" "), F.lower("__t"), F.lit(" ")))
    t, p = F.col("__t"), F.col(primary)
    device = F.coalesce(*(F.when(F.contains("__low", F.lit(token)), F.lit(label)) for token, label in DEVICES))

    def positive(pattern: str) -> Column:
        x = F.regexp_extract(t, pattern, 1).try_cast("double")
        return F.when(x > 0, x)

    vaped, smelt = F.coalesce(p.isin(VAPE, MUSHROOM_VAPE), F.lit(False)), F.coalesce(p.isin(FLOWER, VAPE), F.lit(False))
    species = F.regexp_extract(t, SPECIES, 1)
    named = F.array_compact(F.array(*(F.when(has(t, rf"\b{name}\b"), F.lit(name)) for name in TERPENES)))
    rows = df.withColumn("psilocybin_percent", positive(PSILOCYBIN_PERCENT))
    return rows.withColumns({
        "species": F.when(species != "", F.initcap(species)), "claimed_potency_percent": F.coalesce("psilocybin_percent", positive(POTENCY_PERCENT)), "device_type": F.when(vaped, device),
        "puff_count": F.when(vaped, F.regexp_extract(t, PUFFS, 1).try_cast("int")), "terpenes": F.when(smelt, named).otherwise(F.array().cast("array<string>")), "total_terpenes_percent": F.when(smelt, positive(TERPENE_TOTAL)),
    }).drop("__t", "__low")


def filled_field(df: DataFrame, field: str) -> Column:
    """Neither null, nor "", nor an empty array; false for a field that the rows do not have."""
    if field not in df.columns:
        return F.lit(False)
    c = F.col(field)
    return F.coalesce((F.size(c) > 0) if dict(df.dtypes)[field].startswith(("array", "map")) else (c.cast("string") != ""), F.lit(False))


def completeness(df: DataFrame, primary: str, evidence_type: str) -> Column:
    """0 to 100: 35 for the common fields, 45 for those of the type, 20 for evidence of it; halves go to the even number."""

    def share(fields: list[str], points: int) -> Column:
        return sum(filled_field(df, f).cast("int") for f in fields).cast("decimal(18,4)") * points / len(fields)

    special = F.lit(0).cast("decimal(28,10)")
    for t, fields in TYPE_FIELDS.items():
        special = F.when(F.col(primary) == t, share(fields, 45).cast("decimal(28,10)")).otherwise(special)
    evidence = F.when(F.col(evidence_type) == F.col(primary), 20).otherwise(0)
    return F.bround(share(COMMON_FIELDS, 35).cast("decimal(28,10)") + special + evidence, 0).cast("int")


def records(df: DataFrame, name: str, description: str, url: str, hint: str, price: str) -> DataFrame:
    """A generalised record of each row that has a type: evidence, quantity, comparison price, type fields, completeness."""
    rows = classified(df, name, description, url, hint).withColumnRenamed("primary_type", "__type")
    # Exploded and not filtered: a filter would be moved below the signals, and all of them written out in it once more.
    rows = rows.select("*", F.explode(F.array_compact(F.array("__type"))).alias("primary_type")).drop("__type").withColumn("__all", one_text(name, description))
    rows = type_fields(compared(quantities(rows, "__all", "primary_type"), price), "__all", "primary_type").drop("__all").withColumn("evidence_type", F.col("primary_type"))
    return rows.withColumn("completeness_score", completeness(rows, "primary_type", "evidence_type"))


#: Fixed value: the evidence that proves nothing but itself.
CARD_EVIDENCE = "product_card_title_or_url"


def card_rules() -> gates.Rules:
    return [("unverified_listing_card_evidence", F.col("evidence_source") == CARD_EVIDENCE)]


def _number(name: str) -> Column:
    x = F.col(name).try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x)


def volume_rules(when: Column) -> gates.Rules:
    """Rejections of what is sold by volume. Columns: quantity_unit, grams, volume_ml, quantity_value, comparison_metric,
    comparison_price, price_per_ml, price."""
    ml, per = _number("volume_ml"), _number("price_per_ml")
    expected = _number("price") / ml
    off = expected.isNull() | (F.abs(_number("comparison_price") - per) > TOLERANCE) | (F.abs(per - expected) > TOLERANCE)
    return [
        ("unsupported_vape_mass_quantity", when & ((column("quantity_unit") == "g") | _number("grams").isNotNull())), ("missing_vape_volume", when & ((column("quantity_unit") != "ml") | ml.isNull())),
        ("inconsistent_vape_quantity", when & (F.abs(_number("quantity_value") - ml) > TOLERANCE)),
        ("missing_vape_comparison_price", when & ((column("comparison_metric") != "price_per_ml") | _number("comparison_price").isNull() | per.isNull())), ("inconsistent_vape_comparison_price", when & off),
    ]


def reject_rules() -> gates.Rules:
    """All rejections, in order; the first that holds is the reason. Columns besides those above: name, source_id, vendor,
    source_title, variant, url, public_purchase_url, primary_type, type_tags, evidence_type, availability, the signals."""
    primary = column("primary_type")
    is_ = {t: primary == t for t in TYPES}
    s = {k: F.coalesce(F.col(k), F.lit(False)) for k in SIGNALS}
    mixed = has(one_text("name", "source_title", "variant", "url", "public_purchase_url"), MIXED_OFFER)
    price = F.col("price").cast("string")
    common = [
        ("missing_name", F.trim(column("name")) == ""), ("missing_source_identity", (F.trim(column("source_id")) == "") | (F.trim(column("vendor")) == "")), ("unsupported_mixed_offer", mixed),
        ("missing_or_invalid_internal_product_url", ~F.trim(column("url")).rlike(r"^(?i)https?://[^/?#]+")), ("unsupported_or_missing_primary_type", ~primary.isin(TYPES)),
        ("primary_type_missing_from_type_tags", ~F.coalesce(F.array_contains("type_tags", primary), F.lit(False))), ("classification_evidence_type_mismatch", column("evidence_type") != primary),
        ("missing_current_price", F.coalesce(price, F.lit("")) == ""), ("invalid_current_price", price.try_cast("double").isNull() | (price.try_cast("double") <= 0)), ("not_explicitly_in_stock", column("availability") != "in_stock"),
    ]
    special = [
        ("missing_product_level_thca_evidence", is_[FLOWER] & ~s["explicit_thca"]), ("missing_product_level_flower_evidence", is_[FLOWER] & ~s["explicit_flower"]), ("flower_vape_contamination", is_[FLOWER] & s["explicit_vape"]),
        ("missing_product_level_cannabis_evidence", is_[VAPE] & ~s["explicit_cannabis"]),
        ("missing_product_level_psilocybin_evidence", (is_[MUSHROOM] | is_[MUSHROOM_VAPE]) & ~s["explicit_psilocybin"]),
        ("missing_product_level_vape_evidence", (is_[VAPE] | is_[MUSHROOM_VAPE]) & ~s["explicit_vape"]),
        ("missing_product_level_mushroom_evidence", is_[MUSHROOM] & ~s["explicit_mushroom"]), ("mushroom_vape_contamination", is_[MUSHROOM] & s["explicit_vape"]),
        ("amanita_not_psilocybin", (is_[MUSHROOM] | is_[MUSHROOM_VAPE]) & s["amanita_signal"]),
    ]
    return card_rules() + common + special + volume_rules(is_[VAPE] | is_[MUSHROOM_VAPE])


def strict_rules() -> gates.Rules:
    """What the last gate would refuse anyway, in order."""
    primary, evidence = column("primary_type"), column("evidence_type")
    return [
        ("missing_product_url", F.trim(column("url")) == ""), ("missing_classification_evidence", F.col("evidence_type").isNull()), ("missing_primary_type", (primary == "") | (evidence == "")),
        ("classification_type_mismatch", primary != evidence), *card_rules(),
    ]


def consistent(df: DataFrame) -> DataFrame:
    """Rows whose evidence is of their type."""
    return df.where((column("primary_type") != "") & (F.col("evidence_type") == F.col("primary_type")))


def source_quality(df: DataFrame, source: str) -> DataFrame:
    """A row a source: products, url_coverage, priced_products, evidenced_products, unverified_listing_cards, admitted and
    the reasons against it."""
    evident = F.col("evidence_type").isin(TYPES) & (F.col("evidence_type") == F.col("primary_type"))
    n = df.groupBy(source).agg(
        F.count("url").alias("__rows"), F.count("*").alias("products"), F.count_if(F.trim(column("url")) != "").alias("urls"), F.count_if(_number("price").isNotNull()).alias("priced_products"),
        F.count_if(evident).alias("evidenced_products"), F.count_if(F.col("evidence_source") == CARD_EVIDENCE).alias("unverified_listing_cards"),
    )
    reasons = gates.all_failing([
        ("no_qualifying_products", F.col("products") == 0), ("insufficient_product_urls", F.col("urls") < 0.9 * F.col("products")), ("no_priced_products", F.col("priced_products") == 0),
        ("missing_product_level_evidence", F.col("evidenced_products") != F.col("products")), ("unverified_listing_card_evidence", F.col("unverified_listing_cards") > 0),
    ])
    coverage = F.round(F.col("urls").cast("decimal(20,6)") / F.col("products"), 4).cast("double")
    return n.select(source, "products", coverage.alias("url_coverage"), "priced_products", "evidenced_products", "unverified_listing_cards", reasons.alias("reasons")).withColumn("admitted", F.size("reasons") == 0)


def identity_key() -> Column:
    """A record's id, else its source, type, name, variant and address in lower case; null if all are empty."""
    own = F.trim(column("id"))
    parts = F.concat_ws("|", *(F.lower(F.trim(column(c))) for c in ("source_id", "primary_type", "name", "variant", "url")))
    return F.when(own != "", own).when(F.regexp_replace(parts, r"^\|+|\|+$", "") != "", parts)


#: The fields by which one of two equal records is fuller.
SCORED_FIELDS = ["price", "grams", "volume_ml", "price_per_gram", "price_per_ml", "thca", "psilocybin_percent", "species", "device_type", "terpenes", "image", "availability", "evidence_type"]


def deduplicated(df: DataFrame, tie: Column) -> DataFrame:
    """One row an identity: most fields, then completeness, then the latest; of equals the least `tie`. No identity: none."""
    score = sum(filled_field(df, f).cast("int") for f in SCORED_FIELDS)
    rows = df.withColumn("__key", identity_key()).where("__key IS NOT NULL")
    rank = F.struct(-score, -F.coalesce(F.col("completeness_score"), F.lit(0)))
    w = Window.partitionBy("__key").orderBy(rank, column("collected_at").desc(), tie)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__key", "__n")


def public_view(df: DataFrame) -> DataFrame:
    """Controlled types lose all links; others' public link is their address. Tags in order, raw addresses gone."""
    hidden = F.col("primary_type").isin(CONTROLLED)
    link = F.when(column("public_purchase_url") != "", F.col("public_purchase_url")).otherwise(column("url"))
    known = F.array(*map(F.lit, TYPES))
    place = lambda t: F.struct(F.when(F.array_contains(known, t), F.array_position(known, t)).otherwise(999).alias("p"), t.alias("t"))
    tags = F.transform(F.array_sort(F.transform(F.array_distinct("type_tags"), place)), lambda s: s["t"])
    columns = {"url": F.when(hidden, "").otherwise(link), "public_purchase_url": F.when(~hidden, link), "type_tags": tags, "permits_public_purchase_link": ~hidden}
    if "route_url" in df.columns:
        columns["route_url"] = F.when(hidden, "").otherwise(F.col("route_url"))
    return df.withColumns(columns).drop("source_url", "raw_url")


def floors(df: DataFrame, source: str, least_sources: int, least_products: int) -> DataFrame:
    """(check, measured, passed): no controlled record has a link, and enough sources and products."""
    m = df.agg(
        F.count_if(F.col("primary_type").isin(CONTROLLED) & ((column("url") != "") | F.col("public_purchase_url").isNotNull())).alias("links"), F.count_distinct(source).alias("sources"), F.count("*").alias("products"),
    )
    rows = [("controlled_links", F.col("links"), F.col("links") == 0), ("active_sources", F.col("sources"), F.col("sources") >= least_sources), ("products", F.col("products"), F.col("products") >= least_products)]
    return m.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), v.alias("measured"), ok.alias("passed")) for n, v, ok in rows))).alias("r")).select("r.*")
