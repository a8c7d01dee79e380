"""Best rows: every tie is broken by the caller's last rank, so results do not depend on the order of input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], ranks: list[Column], name: str = "place") -> DataFrame:
    """Each row's place within its key, 1 for the best."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*ranks)))


def best_row(df: DataFrame, keys: list[str], ranks: list[Column]) -> DataFrame:
    """One row a key. A filter on row_number, so Spark drops all but one row a key before the shuffle too."""
    return ranked(df, keys, ranks, "__place").where("__place = 1").drop("__place")


def audit(df: DataFrame, keys: list[str], ranks: list[Column], identity: str) -> DataFrame:
    """All rows that lost, and the identity of the row that won over them."""
    w = Window.partitionBy(*keys).orderBy(*ranks)
    rows = df.withColumn("__place", F.row_number().over(w)).withColumn("kept", F.first(identity).over(w))
    return rows.where("__place > 1").drop("__place")


def losers(df: DataFrame, keys: list[str], rank: Column, identity: str) -> DataFrame:
    """As audit, for keys that a large part of all rows may share: the least of each key by a partial aggregation, joined
    back, so that no window gathers a key's rows. Ranks must differ between rows."""
    best = df.groupBy(*keys).agg(F.min_by(identity, rank).alias("kept"))
    return df.join(best, keys).where(F.col(identity) != F.col("kept"))


def best_of(df: DataFrame, keys: list[str], value: Column, rank: Column, name: str) -> DataFrame:
    """Of each key the value with the highest rank (a struct that ends in a tie-break); one partial aggregation."""
    return df.groupBy(*keys).agg(F.max_by(value, rank).alias(name))


def filled(*fields: str) -> Column:
    """How many of the fields are neither null nor empty."""
    return sum(((F.col(f).isNotNull()) & (F.col(f).cast("string") != "")).cast("int") for f in fields)


def top_with_ties(df: DataFrame, keys: list[str], score: str, columns: list[str]) -> DataFrame:
    """The different values of the columns among each key's rows of highest score. One shuffle, as the last step's keys
    include the window's."""
    top = df.select(*keys, *columns, score, F.max(score).over(Window.partitionBy(*keys)).alias("__top"))
    return top.where(F.col(score) == F.col("__top")).drop("__top").distinct()
