"""Gates: ordered rules, of which the first that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import half_up

Rules = list[tuple[str, Column]]


def first_failing(rules: Rules) -> Column:
    """The first reason whose condition holds, else null. A null condition does not hold."""
    out = F.lit(None).cast("string")
    for reason, fails in reversed(rules):
        out = F.when(F.coalesce(fails, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def split(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected with reason)."""
    judged = df.withColumn("reason", first_failing(rules))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def reason_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count("*").alias("rows"))


def all_failing(rules: Rules) -> Column:
    """All reasons that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(fails, F.lit(False)), F.lit(reason)) for reason, fails in rules)))


def price_fields(df: DataFrame, price: Column, original: Column, grams: Column) -> DataFrame:
    """Adds price, original, discount_percent, per_gram and warning. An original below the price is dropped with a
    warning, one equal to it without. Built step by step: each step's columns are computed once."""
    steps = df.withColumns({"price": F.when(price.between(0.01, 100_000), half_up(price, 2)), "__original": original, "__grams": grams})
    steps = steps.withColumns({"original": F.when(F.col("__original") > F.col("price"), half_up(F.col("__original"), 2)), "warning": F.when(F.col("__original") < F.col("price"), F.lit("original_below_price"))})
    # Divisions are rounded as decimals, so half cents go up in every engine.
    p, o = F.col("price").cast("decimal(18,4)"), F.col("original").cast("decimal(18,4)")
    per = F.when(F.col("__grams") > 0, F.round(p / F.col("__grams").cast("decimal(18,4)"), 4).cast("double"))
    return steps.withColumns({"discount_percent": F.round((o - p) * 100 / o, 2).cast("double"), "per_gram": per}).drop("__original", "__grams")


#: Fixed value: the mass share that stays when the acid form loses its carboxyl group.
ACID_FACTOR = 0.877


def potency(df: DataFrame, direct: Column, base: Column, acid: Column) -> DataFrame:
    """Adds value, display and method: a direct total, else base + 0.877 acid, else 0.877 acid as an estimate; outside 0
    to 100: rejected."""
    steps = df.withColumns({"__direct": direct.cast("decimal(28,9)"), "__base": base.cast("decimal(18,6)"), "__acid": (acid.cast("decimal(18,6)") * F.lit(str(ACID_FACTOR)).cast("decimal(4,3)")).cast("decimal(28,9)")})
    both = F.col("__base").isNotNull() & F.col("__acid").isNotNull()
    method = F.when(F.col("__direct").isNotNull(), F.lit("direct")).when(both, F.lit("calculated")).when(F.col("__acid").isNotNull(), F.lit("estimate")).otherwise(F.lit("unavailable"))
    steps = steps.withColumns({"__value": F.coalesce("__direct", (F.col("__base") + F.col("__acid")).cast("decimal(28,9)"), "__acid"), "__method": method})
    good = F.col("__value").between(0, 100)
    out = steps.withColumns({
        "value": F.when(good, F.round("__value", 4).cast("double")), "display": F.when(good, F.round("__value", 0).cast("int")), "method": F.when(~good, F.lit("rejected")).otherwise(F.col("__method")),
    })
    return out.drop("__direct", "__base", "__acid", "__value", "__method")


def completeness(common: list[Column], special: list[Column], evidence: Column) -> Column:
    """0 to 100: 35 for common fields, 45 for special ones, 20 for evidence; halves go to the even number."""

    def share(fields: list[Column], points: int) -> Column:
        if not fields:
            return F.lit(0).cast("decimal(28,10)")
        there = sum((f.isNotNull() & (f.cast("string") != "")).cast("int") for f in fields)
        return (there * points).cast("decimal(18,4)") / len(fields)

    total = share(common, 35) + share(special, 45) + F.when(evidence, 20).otherwise(0)
    return F.bround(total, 0).cast("int")
