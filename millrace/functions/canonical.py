"""Digests that do not depend on the order of fields, of map entries or of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits by which digests meet at each level of a tree: 256 groups a level.
STEP = 2


def _tidy(c: Column, kind: T.DataType) -> Column:
    """The value with the fields of all its structs in order of name and its maps as sorted entries."""
    if isinstance(kind, T.StructType):
        fields = F.struct(*(_tidy(c[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)))
        return F.when(c.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _tidy(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _tidy(e["value"], kind.valueType).alias("value")))
    return c


def canonical(df: DataFrame) -> Column:
    """Each row as JSON whose fields are in order of name at every level, nulls kept."""
    return F.to_json(F.struct(*(_tidy(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name))), {"ignoreNullFields": "false"})


def row_digests(df: DataFrame) -> DataFrame:
    """(digest): the SHA-256 of each row's canonical JSON."""
    return df.select(F.sha2(canonical(df), 256).alias("digest"))


def tree_root(digests: DataFrame) -> DataFrame:
    """(root, leaves): one digest over all rows (digest), whatever their order.

    Equal digests are one leaf with their number. Leaves meet by their first hex digits, level by level, in groups of some
    hundreds; no row holds more. No rows: the digest of "".
    """
    leaves = digests.groupBy("digest").agg(F.count("*").alias("n"))
    level = leaves.select(F.col("digest").alias("at"), F.sha2(F.concat_ws(":", "digest", "n"), 256).alias("h"), "n")
    n = leaves.count()
    depth = 0
    while 16**depth * 256 < n:
        depth += STEP
    for digits in range(depth, -1, -STEP):
        level = level.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("h")))).getField("h"), ""), 256).alias("h"), F.sum("n").alias("n"))
    whole = level.agg(F.max("h").alias("root"), F.sum("n").alias("leaves"))
    return whole.select(F.coalesce("root", F.sha2(F.lit(""), 256)).alias("root"), F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves"))
