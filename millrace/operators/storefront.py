"""What a shop window shows: compact products, displayed texts, the sizes of a product, typed lists, badges, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import column, name_key, natural_key, search_text
from millrace.operators.offers import variant_rank
from millrace.operators.publication import FLOWER, TYPES
from millrace.operators.ranking import best_row
from millrace.operators.verification import LINEAGES

NONE = "—"


def compact_variants(variants: DataFrame) -> DataFrame:
    """(product_id, variant_id, weight, price, unit_price) of rows with weight or grams, price and price_per_gram; a missing
    unit price is price by weight, a missing id is the product's with the row's place. Rows without all three numbers go."""
    weight = F.coalesce(F.col("weight"), F.col("grams"))
    unit = F.coalesce(F.col("price_per_gram"), F.when(weight != 0, F.col("price") / weight))
    own = F.when(column("variant_id") != "", F.col("variant_id")).otherwise(F.concat_ws(":", "product_id", "place"))
    rows = variants.select("product_id", own.alias("variant_id"), weight.alias("weight"), F.col("price"), unit.alias("unit_price"))
    return rows.where("weight IS NOT NULL AND price IS NOT NULL AND unit_price IS NOT NULL")


def compact_products(products: DataFrame) -> DataFrame:
    """(product_id, vendor_id, vendor, name, lineage, search_text), each from the first name of it that is there."""
    first = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in products.columns), F.lit(""))
    rows = products.select(first("id", "product_id").alias("product_id"), first("vendor_id", "source_id", "vendor").alias("vendor_id"), first("vendor", "vendor_name").alias("vendor"), first("strain", "name").alias("name"), "lineage")
    lineage = F.when(F.col("lineage").isin(LINEAGES), F.col("lineage")).otherwise("unknown")
    return rows.withColumns({"lineage": lineage, "search_text": search_text(F.concat_ws("\n", "vendor", "name"))}).where("product_id <> ''")


def money(c: Column) -> Column:
    """$ and the amount, with cents where there are any."""
    return F.when(c.isNull() | F.isnan(c), NONE).when(c == F.floor(c), F.format_string("$%.0f", c)).otherwise(F.format_string("$%.2f", c))


def unit_price(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), NONE).otherwise(F.format_string("$%.2f/g", c))


def weight(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), NONE).when(c == F.floor(c), F.format_string("%.0fg", c)).otherwise(F.format_string("%.1fg", c))


def percent(c: Column) -> Column:
    """Whole per cent, halves up; "—" for none and outside 0 to 100."""
    return F.when(c.between(0, 100), F.concat(F.floor(c + 0.5).cast("string"), F.lit("%"))).otherwise(NONE)


def rating(score: Column, count: Column) -> Column:
    """Score and number of reviews, if both are valid, else null."""
    return F.when(score.between(0, 5) & (count >= 1) & (count == F.floor(count)), F.concat(F.format_string("%.1f", score), F.lit(" ("), count.cast("long").cast("string"), F.lit(")")))


def discount(original: Column, price: Column) -> Column:
    return F.when((original > 0) & (original > price) & (price > 0), F.floor((original - price) / original * 100 + 0.5).cast("int"))


def title_of(code: Column) -> Column:
    """A code such as indica_leaning_hybrid as words: "Indica-leaning hybrid"."""
    words = F.replace(F.replace(code, F.lit("_leaning_"), F.lit("-leaning ")), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000))


def sizes(variants: DataFrame, usable: Column, place: str) -> DataFrame:
    """The variants that a product shows: of one id the first by place, then of one weight (to 6 places) the best."""
    rows = best_row(variants.where(usable), ["product_id", "variant_id"], [F.asc(place)])
    return best_row(rows.withColumn("__weight", F.round("grams", 6)), ["product_id", "__weight"], [variant_rank().asc()]).drop("__weight")


def vendors(products: DataFrame, place: str) -> DataFrame:
    """(vendor_id, name): the first name of each vendor that has an id, a name and a variant to show."""
    rows = products.where((F.trim(column("vendor_id")) != "") & (F.trim(column("vendor_name")) != "") & F.col("has_variants"))
    return rows.groupBy("vendor_id").agg(F.min_by("vendor_name", place).alias("name"))


def inferred_type(explicit: Column, evident: Column, thca: Column, flower: Column) -> Column:
    """The stated type, else that of the evidence, else flower by its two signals, else null."""
    stated = F.coalesce(explicit, evident)
    return F.when(stated.isin(TYPES), stated).when(F.coalesce(thca & flower, F.lit(False)), FLOWER)


#: Sort of the typed list: (column, falling).
TYPED_SORTS = {"price_asc": ("price", False), "price_desc": ("price", True), "metric_asc": ("comparison_price", False), "metric_desc": ("comparison_price", True), "completeness_desc": ("completeness_score", True)}


def typed_order(sort: str, name: str, place: str) -> list[Column]:
    """Nulls last whether rising or falling; ties as they came; any other sort is by name."""
    if sort not in TYPED_SORTS:
        return [natural_key(name).asc(), F.asc(place)]
    c, falling = TYPED_SORTS[sort]
    return [F.col(c).desc_nulls_last() if falling else F.col(c).asc_nulls_last(), F.asc(place)]


def typed_filter(df: DataFrame, vendor: str = "", text: str = "") -> DataFrame:
    """Rows of the vendor whose vendor, name or species hold the text, in any case."""
    needle = text.strip().lower()
    keep = (F.col("vendor") == vendor) if vendor else F.lit(True)
    return df.where(keep & F.lower(F.concat_ws("\n", column("vendor"), column("name"), column("species"))).contains(needle))


def badges(products: DataFrame, profiles: DataFrame, place: str) -> DataFrame:
    """Products with their vendor's badge, by normalised name; of several profiles of a name the last counts."""
    best = best_row(profiles.withColumn("__key", name_key("vendor_name")), ["__key"], [F.desc(place)])
    shown = display(F.col("display"), F.col("classification"))
    return products.withColumn("__key", name_key("vendor")).join(best.select("__key", shown.alias("badge")), "__key", "left").drop("__key")


def display(stated: Column, classification: Column) -> Column:
    # What a classification is shown as.
    return (
        F.when(stated.isin("verification", "confirmation", "no_gate_observed", "unknown"), stated)
        .when(classification.isin("identity_verification_required", "identity_verification_conditional"), "verification")
        .when(classification == "self_attestation_21_plus", "confirmation").when(classification == "no_observed_gate", "no_gate_observed").otherwise("unknown")
    )


def retained(pages: DataFrame, offset: str, place: str) -> DataFrame:
    """The rows of all pages held, each product where it comes first."""
    return best_row(pages, ["product_id"], [F.asc(offset), F.asc(place)])


def with_details(variants: DataFrame, details: DataFrame, fields: list[str]) -> DataFrame:
    """Index variants with the details' fields, null where there are none."""
    return variants.join(details.select("variant_id", *fields), "variant_id", "left")


def document_of(documents: Column, kind: str) -> Column:
    """The first document of the kind, else the first combined one, else null."""
    of = lambda k: F.get(F.filter(documents, lambda d: d["kind"] == k), F.lit(0))
    return F.coalesce(of(kind), of("combined_lab_report"))
