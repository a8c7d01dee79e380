"""Shop feeds with simple products, variations and variable parents; admission of single records; route reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.extract import POUND_GRAMS, POUNDS, WORD_POUNDS, label_grams, lookup, stock, weight
from millrace.functions.positions import let
from millrace.functions.text import column, plain_text
from millrace.operators import gates


def store_price(sale: Column, price: Column, regular: Column, minor_unit: Column) -> Column:
    """The first positive one, in whole currency: given in units of 10 ** -minor_unit, where none and 0 mean 2."""
    positive = lambda c: F.when(c.try_cast("double") > 0, c.try_cast("decimal(18,4)"))
    digits = F.coalesce(F.when(minor_unit != 0, minor_unit), F.lit(2))
    return F.round(F.coalesce(positive(sale), positive(price), positive(regular)).cast("double") / F.pow(F.lit(10.0), digits), 4)


def variation_label(variation: Column, attributes: Column, name: Column, parent: Column) -> Column:
    """The stated label, else the attributes' values, else what the name adds to its parent's."""
    values = F.array_join(F.filter(attributes, lambda v: F.trim(v) != ""), " / ")

    def label(x: Column) -> Column:
        own, n, p = x["own"], x["name"], x["parent"]
        rest = F.when((p != "") & F.startswith(F.lower(n), F.lower(p)), F.regexp_replace(F.substring(n, F.length(p) + 1, F.length(n)), r"^[ \-–—:]+", "")).otherwise(n)
        return F.when(own != "", own).when(F.coalesce(values, F.lit("")) != "", values).otherwise(rest)

    return let(F.struct(plain_text(variation).alias("own"), plain_text(name).alias("name"), plain_text(parent).alias("parent")), label)


def store_rows(items: DataFrame) -> DataFrame:
    """Rows of a feed's items (id, type, parent, name, has_options, stock, variation, attributes, sale_price, price,
    regular_price, minor_unit): simple products, variations that stand alone, and the children of variable parents; with the
    reason where a variation is refused. Variable parents give no rows of their own."""
    kind = F.lower(column("type"))
    child = (kind == "variation") | F.col("parent").isNotNull()
    variable = ~child & (F.coalesce(F.col("has_options"), F.lit(False)) | (kind == "variable"))
    rows = items.withColumns({"is_child": child, "is_variable": variable}).where("NOT is_variable")
    parents = items.where(variable).select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    rows = rows.join(parents.dropDuplicates(["parent"]), "parent", "left")
    label = variation_label(F.col("variation"), F.col("attributes"), F.col("name"), F.col("parent_name"))
    rows = rows.withColumns({"label": F.when(F.col("is_child"), label), "current": store_price(F.col("sale_price"), F.col("price"), F.col("regular_price"), F.col("minor_unit"))})
    rows = rows.withColumn("grams", F.when(F.col("is_child"), label_grams("label")["grams"]))
    reason = gates.first_failing([
        ("variation_not_explicitly_in_stock", F.col("is_child") & ~F.coalesce(stock("stock")["in_stock"], F.lit(False))), ("variation_weight_missing", F.col("is_child") & ((column("label") == "") | F.col("grams").isNull())),
    ])
    name = F.when(F.col("is_child"), F.concat_ws(" ", F.coalesce("parent_name", "name"), "label")).otherwise(F.col("name"))
    return rows.select("id", "parent", name.alias("name"), "label", "grams", F.col("current").alias("price"), reason.alias("reason"))


#: In which fields a weight is looked for.
WEIGHT_FIELDS = ["source_weight_label", "weight_label", "variant", "weight", "size", "source_title", "name", "title"]


def pound_repair(direct: Column, label: Column) -> Column:
    """The label's grams where it names pounds and the number is a sixteenth of it: pounds once read as ounces. Else null."""
    found, word = F.regexp_extract(label, POUNDS, 1), F.lower(F.regexp_extract(label, WORD_POUNDS, 1))
    grams = F.coalesce(lookup(found, POUND_GRAMS), lookup(word, POUND_GRAMS))
    off = F.abs(grams - direct * 16)
    return F.when(direct.between(0.05, 5000) & (label_grams(label)["grams"] == grams) & (off <= F.greatest(F.lit(0.05), grams * 0.02)), grams)


def flower_rows(df: DataFrame) -> DataFrame:
    """Rows without another type than flower; their grams and label from the first field that gives them: a label that agrees
    with the number, else a repaired pound. Others keep what they have."""
    kind = F.lower(F.trim(F.coalesce(F.when(F.trim(column("primary_type")) != "", F.col("primary_type")), F.col("evidence_type"), F.lit(""))))
    rows = df.where(kind.isin("", "cannabis_flower"))
    direct = F.coalesce(F.col("grams"), F.col("weight_grams")) if "weight_grams" in df.columns else F.col("grams")
    tried, fields = [], [f for f in WEIGHT_FIELDS if f in df.columns]
    rows = rows.withColumns({f"__t_{f}": plain_text(f) for f in fields})
    for field in fields:
        text = F.col(f"__t_{field}")
        agreed = weight(direct, text)
        grams = F.coalesce(F.when(agreed["method"].isin("agreed", "label"), agreed["grams"]), pound_repair(direct, text))
        tried.append(F.when((text != "") & grams.isNotNull(), F.struct(grams.alias("grams"), label_grams(text)["label"].alias("label"))))
    rows = rows.withColumn("__w", F.coalesce(*tried))
    return rows.withColumns({"grams": F.coalesce("__w.grams", "grams"), "source_weight_label": F.coalesce("__w.label", "source_weight_label")}).drop("__w", *(f"__t_{f}" for f in fields))


#: Potency methods by how far they are to be trusted.
POTENCY_RANK = {"direct_source_total_thc": 4, "delta9_plus_thca_times_0_877": 3, "thca_only_estimate": 2, "unavailable": 0}


def best_potency(df: DataFrame, key: str) -> DataFrame:
    """(key, value, method) of the record whose method ranks highest, then one with a value, then the latest, then the last."""
    ranks = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in POTENCY_RANK.items() for x in pair)), F.col("method")), F.lit(1))
    best = df.groupBy(key).agg(F.max_by(F.struct("value", "method"), F.struct(ranks, F.col("value").isNotNull(), F.coalesce("collected_at", F.lit("")), "record_id")).alias("b"))
    return best.select(key, "b.*")


#: What a public report of a route may hold.
MOST_REASONS, MOST_FAILURES, MOST_RECORDS, MOST_ERROR = 12, 100_000, 24, 300


def public_route(df: DataFrame, public: list[str]) -> DataFrame:
    """The public fields of a route's report; reasons (a map of counts) in order of name, well-formed ones only, the first 12;
    counts, records and the error text within bounds."""
    entries = F.array_sort(F.map_entries(F.map_filter("reasons", lambda k, v: k.rlike("^[a-z][a-z0-9_]{2,63}$") & (v > 0))))
    kept = F.transform(F.slice(entries, 1, MOST_REASONS), lambda e: F.struct(e["key"].alias("key"), F.least(e["value"], F.lit(MOST_FAILURES)).alias("value")))
    rows = df.withColumn("__kept", kept)
    total = F.aggregate("__kept", F.lit(0).cast("long"), lambda a, e: a + e["value"])
    failures = F.when(F.size("__kept") > 0, F.least(total, F.lit(MOST_FAILURES))).when(F.col("failures") > 0, F.least("failures", F.lit(MOST_FAILURES)))
    return rows.select(*(F.when(F.col(f).cast("string") != "", F.col(f)).alias(f) for f in public), F.map_from_entries("__kept").alias("reasons"), failures.cast("long").alias("failures"), F.slice("records", 1, MOST_RECORDS).alias("records"), F.when(column("error") != "", F.substring("error", 1, MOST_ERROR)).alias("error"))


def summed_counts(df: DataFrame, keys: list[str], counters: list[str], maps: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Sums of counters a key, and of each map's values a key and name."""
    sums = df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counters))
    return sums, {m: df.select(*keys, F.explode(m).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("n")) for m in maps}


def merged_routes(existing: DataFrame, new: DataFrame, keys: list[str], place: str) -> DataFrame:
    """All routes, each (type, address without its last slash) once: an existing one before a new one, then as they came."""
    rows = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))).where(column("type").isin("html", "shopify", "woo", "json") & column("url").startswith("https://"))
    w = Window.partitionBy(*keys, "type", F.regexp_replace("url", "/+$", "")).orderBy("__new", place)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def all_or_nothing(df: DataFrame, route: str, failed: Column) -> DataFrame:
    """Rows of routes without any failure; one failure discards all rows of its route."""
    return df.join(df.where(F.coalesce(failed, F.lit(False))).select(route).distinct(), route, "left_anti")
