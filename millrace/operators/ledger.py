"""Tables that are added to and reported from: insert if absent, states, stamps, nested index rows, report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import column, natural_key


def inserted(existing: DataFrame, new: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(the rows to add, the conflicts): a new key is added once; the same content again is nothing; other content under a
    known or repeated key is a conflict, and such a key is not added."""
    rows = new.select(key, content, *[c for c in new.columns if c not in (key, content)])
    kinds = rows.groupBy(key).agg(F.min(content).alias("least"), F.max(content).alias("most"))
    known = kinds.join(existing.select(key, F.col(content).alias("old")), key, "left")
    conflict = (F.col("least") != F.col("most")) | (F.col("old") != F.col("least"))
    judged = known.select(key, F.coalesce(conflict, F.lit(False)).alias("conflict"), F.col("old").isNotNull().alias("known"))
    fresh = judged.where("NOT conflict AND NOT known").select(key)
    return rows.join(fresh, key, "left_semi").dropDuplicates([key]), judged.where("conflict").select(key)


def updated(table: DataFrame, changes: DataFrame, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(the table with the field changed where a change names its key, the changes of keys that are not there)."""
    c = changes.select(key, F.col(field).alias("__new"), F.lit(True).alias("__there"))
    out = table.join(c, key, "left").withColumn(field, F.when(F.col("__there"), F.col("__new")).otherwise(F.col(field))).drop("__new", "__there")
    return out.select(table.columns), changes.join(table.select(key), key, "left_anti")


def stamped(shards: DataFrame, commit: str) -> tuple[DataFrame, DataFrame]:
    """(shards with their commit, those that already have another one and keep it)."""
    own = column("source_commit")
    return shards.withColumn("source_commit", F.when(own == "", F.lit(commit)).otherwise(F.col("source_commit"))), shards.where((own != "") & (own != commit))


def index_rows(products: DataFrame, variants: DataFrame, fields: list[str]) -> DataFrame:
    """A nested row a product: its fields, its variants in order of weight, price and id, and the default one. A product's
    variants are few, so they fit a row."""
    v = F.struct("grams", "current_price", "variant_id", "price_per_gram", "in_stock")
    nested = variants.groupBy("product_id").agg(F.array_sort(F.collect_list(v)).alias("variants"))
    best = F.array_min(F.transform(F.filter("variants", lambda x: x["in_stock"]), lambda x: F.struct(x["price_per_gram"], x["current_price"], x["grams"], x["variant_id"].alias("id"))))
    rows = products.select("product_id", *fields).join(nested, "product_id", "left")
    return rows.withColumn("default_variant_id", best["id"])


def renderable(products: DataFrame, usable) -> DataFrame:
    """Nested rows with only their usable variants; products left without any go."""
    return products.withColumn("variants", F.filter("variants", usable)).where(F.size("variants") > 0)


def ordered(df: DataFrame, keys: list[Column], name: str = "place", within: list[str] | None = None) -> DataFrame:
    """Each row's place in a total order, within the keys of a group; without groups, for bounded lists only."""
    w = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(*keys)
    return df.withColumn(name, F.row_number().over(w))


def product_order() -> list[Column]:
    return [F.lower("vendor_name").asc(), F.lower("strain_name").asc(), F.asc("product_id")]


def rejection_order() -> list[Column]:
    return [column(c).asc() for c in ("source_id", "source_title", "source_record_id", "reason")]


#: Sorts of the shop window: (column, falling, text).
WINDOW_SORTS = {
    "lowest_price": ("price", False, False), "highest_price": ("price", True, False), "lowest_price_per_gram": ("unit_price", False, False), "highest_price_per_gram": ("unit_price", True, False),
    "strain_az": ("name", False, True), "strain_za": ("name", True, True), "vendor_az": ("vendor", False, True), "vendor_za": ("vendor", True, True),
}


def window_order(sort: str, place: str) -> list[Column]:
    """Ties by product id in natural order, then as they came."""
    name, falling, text = WINDOW_SORTS[sort]
    key = natural_key(name) if text else F.col(name)
    return [key.desc() if falling else key.asc(), natural_key("product_id").asc(), F.asc(place)]


def annotated(products: DataFrame, decisions: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Products with the documents that were decided for them: (product_id, vendor_id, documents), all products, those of other
    vendors left out. decisions: product_id, document_id, status; candidates: document_id, vendor_id, kind; records:
    document_id, parse_status."""
    held = decisions.where("status = 'matched'").select("product_id", "document_id").join(candidates.select("document_id", F.col("vendor_id").alias("document_vendor"), "kind"), "document_id").join(records, "document_id", "left")
    rows = products.select("product_id", "vendor_id").join(held, "product_id", "left")
    own = F.col("document_vendor") == F.col("vendor_id")
    one = F.when(own, F.struct("document_id", "kind", F.coalesce("parse_status", F.lit("unparsed")).alias("parse_status")))
    return rows.groupBy("product_id", "vendor_id").agg(F.array_sort(F.collect_list(one)).alias("documents"))


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as JSON, keys in order of name, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Each report as a folder of JSON lines, written aside and committed by Spark as a whole."""
    for name, df in reports.items():
        json_lines(df).write.mode("overwrite").text(f"{folder}/{name}")


def receipt(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: files' hashes as one digest, their number and bytes, and all metrics (name, value) as a map."""
    own = files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256"))), "\n"), 256).alias("digest"))
    named = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))
    return own.withColumn("__one", F.lit(1)).join(named.withColumn("__one", F.lit(1)), "__one").drop("__one")
