"""Documents mapped to products: conflicts go, points add up, and of each product and kind of document the best one is taken.

A document belongs to a product of its vendor if their product ids are equal, or if the one's name holds the other's. Products
that say the same are one target, and documents that say the same are one class with their number, so copies of any number make
no pairs. Names that hold each other are found without comparing all names of a vendor: the shorter one's rarest run of three
characters is looked up among the runs of the longer ones, and what is found is compared.

Null fields: as empty; a weight of null is none. Texts are compared in lower case, with all but letters a to z and digits as one
blank. Repeated product rows: each gets its decisions. Several documents of the highest score: ambiguous, and the one of the
least id is named. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import column
from millrace.sources.tables import settled

#: Points of each agreement, each more than all broader ones together, and what scope it gives.
VENDOR_POINTS = 5
POINTS = {"exact product id": (80, "product"), "normalized product-name match": (45, "product"), "exact variant id": (1000, "variant"), "exact variant label": (900, "variant"), "exact normalized weight": (200, "weight"), "exact batch id": (500, "batch")}
SCOPES = ("variant", "batch", "weight", "product")
ROLES = ("coa", "terpene_report", "combined_lab_report", "legal_document", "unknown")
WEIGHT_OFF = 0.02
SAID = ["vendor", "product_id", "variant_id", "variant", "label", "batch", "name", "grams"]


def norm(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(column(c)), "[^a-z0-9]+", " "))


def _said(df: DataFrame, extra: list[str]) -> DataFrame:
    """What rows say, normalised, as columns of SAID, and `says`, a digest of it."""
    variant = F.coalesce(F.nullif(column("variant_id"), F.lit("")), column("variant"))
    rows = df.select(
        *extra, column("vendor").alias("vendor"), column("product_id").alias("product_id"), column("variant_id").alias("variant_id"), variant.alias("variant"), norm("label").alias("label"),
        norm("batch").alias("batch"), norm("name").alias("name"), F.round(F.col("grams").cast("double"), 4).alias("grams"),
    )
    return rows.withColumn("says", F.sha2(F.to_json(F.struct(*SAID, *[c for c in extra if c == "kind"])), 256))


def _runs(name: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct runs of characters of these sizes."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(n)))
    return F.array_distinct(F.filter(F.concat(*(one(n) for n in sizes)), lambda x: x != ""))


def holding(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """(vendor, shorter, longer): names (vendor, name) of the one side that stand in names of the other."""
    hay = longer.select("vendor", F.col("name").alias("longer"), F.explode(_runs(F.col("name"), (1, 2, 3))).alias("run"))
    known = hay.groupBy("vendor", "run").agg(F.count("*").alias("n"))
    own = shorter.select("vendor", F.col("name").alias("shorter"), F.explode(F.when(F.length("name") >= 3, _runs(F.col("name"), (3,))).otherwise(F.array("name"))).alias("run"))
    # Of a name with a run that no longer one has, the rarest run is this one, and it finds nothing.
    rarest = own.join(known, ["vendor", "run"], "left").groupBy("vendor", "shorter").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "run")).alias("r")).select("vendor", "shorter", F.col("r.run").alias("run"))
    return rarest.join(hay, ["vendor", "run"]).where(F.contains("longer", "shorter")).select("vendor", "shorter", "longer")


def _pairs(targets: DataFrame, classes: DataFrame) -> DataFrame:
    """Targets (columns t_) with classes of documents (columns d_) that belong to them."""
    t = targets.select(*(F.col(c).alias(f"t_{c}") for c in targets.columns))
    d = classes.select(*(F.col(c).alias(f"d_{c}") for c in classes.columns))
    by_id = t.where("t_product_id <> ''").join(d, (F.col("t_vendor") == F.col("d_vendor")) & (F.col("t_product_id") == F.col("d_product_id")))
    names = lambda df: df.where("name <> ''").select("vendor", "name").distinct()
    a, b = holding(names(targets), names(classes)), holding(names(classes), names(targets))
    named = a.select("vendor", F.col("shorter").alias("x"), F.col("longer").alias("y")).unionByName(b.select("vendor", F.col("longer").alias("x"), F.col("shorter").alias("y"))).distinct()
    others = (F.col("t_product_id") == "") | (F.col("d_product_id") == "")  # equal ids are found above, others conflict
    by_name = t.join(named, (F.col("t_vendor") == F.col("vendor")) & (F.col("t_name") == F.col("x"))).join(d, (F.col("d_vendor") == F.col("vendor")) & (F.col("d_name") == F.col("y"))).where(others)
    return by_id.withColumn("by_id", F.lit(True)).unionByName(by_name.select(*by_id.columns).withColumn("by_id", F.lit(False)))


def decisions(products: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, vendor, product_id, variant, kind, document_id, scope, score, reasons, ambiguous), a row for each product row and
    kind of document that has any. products: key, vendor, product_id, variant_id, variant, label, batch, name, grams; documents: the
    same without key, with document_id and kind."""
    rows = settled(_said(products, [key]), "products")
    targets = rows.select("says", *SAID).dropDuplicates(["says"])
    said = _said(documents.withColumn("kind", F.coalesce(F.nullif(column("kind"), F.lit("")), F.lit("unknown"))), ["document_id", "kind"])
    classes = settled(said.groupBy("says", "kind", *SAID).agg(F.min("document_id").alias("document_id"), F.count("*").alias("n")), "documents")
    both = lambda c: (F.col(f"t_{c}") != "") & (F.col(f"d_{c}") != "")
    same = lambda c: both(c) & (F.col(f"t_{c}") == F.col(f"d_{c}"))
    differ = lambda c: both(c) & (F.col(f"t_{c}") != F.col(f"d_{c}"))
    off = F.abs(F.col("t_grams") - F.col("d_grams"))
    conflict = differ("variant_id") | (~same("variant_id") & differ("label")) | differ("batch") | F.coalesce(off > WEIGHT_OFF, F.lit(False))
    own_variant = (F.col("t_variant") != "") & (F.col("d_variant_id") != "") & (F.col("t_variant") == F.col("d_variant_id"))
    holds = {
        "exact product id": F.col("by_id"), "normalized product-name match": ~F.col("by_id"), "exact variant id": own_variant, "exact variant label": ~own_variant & same("label"),
        "exact normalized weight": F.coalesce(off <= WEIGHT_OFF, F.lit(False)), "exact batch id": same("batch"),
    }
    pairs = _pairs(targets, classes).where(~conflict).withColumns({f"h{i}": holds[name] for i, name in enumerate(POINTS)})
    score = sum((F.when(F.col(f"h{i}"), POINTS[name][0]).otherwise(0) for i, name in enumerate(POINTS)), F.lit(VENDOR_POINTS))
    reasons = F.array_compact(F.array(F.lit("same vendor"), *(F.when(F.col(f"h{i}"), F.lit(name)) for i, name in enumerate(POINTS))))
    scope = F.coalesce(*(F.when(F.col(f"h{i}"), F.lit(s)) for s in SCOPES for i, name in enumerate(POINTS) if POINTS[name][1] == s))
    found = pairs.select(F.col("t_says").alias("says"), F.col("d_kind").alias("kind"), score.alias("score"), F.col("d_document_id").alias("document_id"), F.col("d_n").alias("n"), scope.alias("scope"), reasons.alias("reasons"))
    top = found.groupBy("says", "kind", "score").agg(F.min(F.struct("document_id", "scope", "reasons")).alias("f"), F.sum("n").alias("n"))
    best = top.groupBy("says", "kind").agg(F.max_by(F.struct("score", "f", "n"), "score").alias("b"))
    best = best.select("says", "kind", "b.f.document_id", "b.f.scope", F.col("b.score").cast("int").alias("score"), "b.f.reasons", (F.col("b.n") > 1).alias("ambiguous"))
    return rows.select(key, "vendor", "product_id", "variant", "says").join(best, "says").drop("says")


def decision_order() -> list[Column]:
    """By vendor, product, variant, the rank of the kind, document."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), F.col("kind")), F.lit(0)), F.lit(100))
    return [F.asc("vendor"), F.asc("product_id"), F.asc("variant"), rank.asc(), F.asc("document_id")]


def placed(found: DataFrame, key: str) -> DataFrame:
    """Decisions with their place among those of their vendor; ties by key."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("vendor").orderBy(*decision_order(), F.asc(key))))
