"""Numbers from untidy columns. Bad input is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import column


def decimal(c: Column | str, least: float | None = None, most: float | None = None) -> Column:
    """A decimal(18, 6) from a number or a text such as "$1,234.50"; outside the bounds: null."""
    x = F.regexp_replace(F.trim(column(c)), r"[$,]", "").try_cast("decimal(18,6)")
    ok = x.isNotNull()
    if least is not None:
        ok = ok & (x >= F.lit(str(least)).cast("decimal(18,6)"))
    if most is not None:
        ok = ok & (x <= F.lit(str(most)).cast("decimal(18,6)"))
    return F.when(ok, x)


def half_up(c: Column, places: int) -> Column:
    return F.round(c.cast("decimal(28,10)"), places).cast("double")


def half_even(c: Column, places: int) -> Column:
    return F.bround(c.cast("decimal(28,10)"), places).cast("double")


def positive(c: Column | str) -> Column:
    """A finite number above 0."""
    x = column(c).try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x)


#: Fixed value: how reports say that nothing was found.
NOT_DETECTED = r"(?i)\b(?:nd|n/?d|non[- ]?detect(?:ed|able)?|below\s+(?:loq|lod))\b"


def percent(c: Column | str) -> Column:
    """The first "n %" of a text, 0 to 100; "not detected" in its spellings is 0."""
    text = column(c)
    found = F.regexp_extract(text, r"(?<!\d)(\d{1,3}(?:\.\d+)?)\s*%?", 1).try_cast("decimal(18,6)")
    none = text.rlike(NOT_DETECTED)
    return F.when(none, F.lit(0).cast("decimal(18,6)")).otherwise(F.when(found.between(0, 100), found))


def largest_percent(c: Column | str) -> Column:
    """The largest "n %" of a text."""
    return F.array_max(F.transform(F.regexp_extract_all(column(c), F.lit(r"(\d{1,3}(?:\.\d+)?)\s*%"), F.lit(1)), lambda x: x.try_cast("double")))


def rating_pair(score: Column, count: Column) -> Column:
    """struct(score, count) if both are valid (0 to 5; whole, 1 to 100,000,000), else null."""
    s, n = decimal(score, 0, 5), decimal(count, 1, 100_000_000)
    return F.when(s.isNotNull() & n.isNotNull() & (n == F.floor(n)), F.struct(half_even(s, 2).alias("score"), n.cast("long").alias("count")))


def drop_share(before: Column, after: Column) -> Column:
    """How much of `before` is gone, 0 to 1; 0 where there was nothing."""
    return F.when(before > 0, F.greatest(F.lit(0.0), (before - after) / before)).otherwise(F.lit(0.0))


def within(c: Column, low: float | None, high: float | None) -> Column:
    """low <= c <= high; a null c passes only if neither bound is set."""
    if low is None and high is None:
        return F.lit(True)
    ok = c.isNotNull()
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return ok
