"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one or two shuffles of the links; the number of steps grows with the logarithm of the longest chain. A hot
node's links are reduced to minima before the shuffle. Tables between steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of links: their number and two sums over hashes of them."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the least node of its component."""
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    state = _state(edges)
    while True:
        # Large star: each node's larger neighbours (and itself) go to its least neighbour or itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: of what points down from a node, all goes to the least.
        large = stored(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = stored(small.where("u <> v").distinct(), "small-star")
        before, state, edges = state, _state(new), new
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
