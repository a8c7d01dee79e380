"""Stable identities: SHA-256 over parts joined by the unit separator, as shortened hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import column

SEPARATOR = "\x1f"


def digest(*parts: Column | str, length: int = 24) -> Column:
    """A null part counts as ""."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *(column(p) for p in parts)), 256), 1, length)


def ladder(rungs: list[tuple[str, Column]], *scope: Column | str, length: int = 24) -> Column:
    """struct(id, method): the digest of scope, method and the first rung that is not empty."""
    method, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, c in reversed(rungs):
        there = column(c) != ""
        method, value = F.when(there, F.lit(name)).otherwise(method), F.when(there, column(c)).otherwise(value)
    return F.when(method.isNotNull(), F.struct(digest(*scope, method, value, length=length).alias("id"), method.alias("method")))


def bucket(identity: Column | str, buckets: int) -> Column:
    """The first 8 hex digits of an identity modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(column(identity), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def canonical_json(*columns: str) -> Column:
    """JSON of the columns in order of name, nulls left out."""
    return F.to_json(F.struct(*sorted(columns)))


def content_digest(*columns: str, length: int = 32) -> Column:
    return F.substring(F.sha2(canonical_json(*columns), 256), 1, length)
