"""Joins: by one of several keys, scored with ambiguity, by scope, filling gaps, carrying forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_any_key(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], right_id: str) -> DataFrame:
    """Each left row with each right row of which any key agrees, once. Keys become rows, so Spark joins on equality."""
    names = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(k).cast("string").alias("key")) for i, k in enumerate(left_keys)))
    a = left.withColumn("__ord", F.monotonically_increasing_id()) if "__ord" not in left.columns else left
    a = a.withColumn("__k", F.explode(names)).where("__k.key IS NOT NULL AND __k.key <> ''")
    others = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(k).cast("string").alias("key")) for i, k in enumerate(right_keys)))
    b = right.withColumn("__k", F.explode(others)).where("__k.key IS NOT NULL AND __k.key <> ''")
    return a.join(b, "__k").drop("__k").dropDuplicates(["__ord", right_id]).drop("__ord")


def scored(pairs: DataFrame, conflicts: Column, points: list[tuple[str, Column, int]], needed: Column) -> DataFrame:
    """Pairs without conflict and with what is needed, their score and the reasons for it."""
    score = sum(F.when(F.coalesce(holds, F.lit(False)), value).otherwise(0) for _, holds, value in points)
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds, _ in points)))
    return pairs.where(~F.coalesce(conflicts, F.lit(False)) & F.coalesce(needed, F.lit(False))).withColumn("score", score.cast("int")).withColumn("reasons", reasons)


def decide(scored_pairs: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """Of each key the candidate of highest score; several of one score: ambiguous, and none is taken."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), candidate)
    top = scored_pairs.withColumn("__n", F.row_number().over(w)).withColumn("__top", F.max("score").over(Window.partitionBy(*keys)))
    top = top.withColumn("rivals", F.sum((F.col("score") == F.col("__top")).cast("int")).over(Window.partitionBy(*keys)))
    first = top.where("__n = 1")
    status = F.when(F.col("rivals") > 1, F.lit("ambiguous")).otherwise(F.lit("matched"))
    return first.select(*keys, F.when(F.col("rivals") == 1, F.col(candidate)).alias(candidate), "score", F.col("rivals").cast("long").alias("rivals"), status.alias("status"))


def fill(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left rows, fields that are null filled from the right; nothing is overwritten, no row is lost."""
    r = right.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    out = left.join(r, key, "left")
    return out.select(*(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in left.columns))


def carry_forward(current: DataFrame, previous: DataFrame, source: str, healthy: DataFrame) -> DataFrame:
    """Current rows, and those of sources that are gone now and were not seen healthy, marked stale."""
    gone = previous.join(current.select(source).distinct(), source, "left_anti").join(healthy.select(source).distinct(), source, "left_anti")
    return current.withColumn("stale", F.lit(False)).unionByName(gone.withColumn("stale", F.lit(True)))


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: (key, side)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_a = a.join(b, key, "left_anti").withColumn("side", F.lit("left_only"))
    return only_a.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))
