"""Where patterns and words stand in texts, and the text around them. Positions are counted in characters, from 0.

A text's matches are found once, and windows are cut inside the row, so that no row with the whole text is made for each match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPOTS = "array<struct<start:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _laid_out(between: Column, lengths: Column) -> Column:
    """Starts and ends of the matches: `lengths` of them, with the texts before, between and after them."""
    steps = F.filter(F.arrays_zip(F.transform(between, lambda b: F.length(b)).alias("gap"), lengths.alias("size")), lambda z: z["size"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPOTS).alias("found"))

    def put(a: Column, z: Column) -> Column:
        begin = a["at"] + z["gap"]
        return F.struct((begin + z["size"]).alias("at"), F.array_append(a["found"], F.struct(begin.alias("start"), (begin + z["size"]).alias("end"))).alias("found"))

    return F.aggregate(steps, start, put, lambda a: a["found"])


def spots(text: Column, pattern: str) -> Column:
    """array<struct(start, end)> of all matches of a pattern that matches no empty text."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    return _laid_out(F.split(text, pattern, -1), lengths)


def places(text: Column, needle: Column) -> Column:
    """As spots, of a needle that differs by row; none for an empty needle."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    between = F.split(text, quoted, -1)
    lengths = F.transform(F.sequence(F.lit(1), F.size(between) - 1), lambda _: F.length(needle))
    return F.when((F.coalesce(needle, F.lit("")) == "") | (F.size(between) < 2), F.array().cast(_SPOTS)).otherwise(_laid_out(between, lengths))


def cut(text: Column, first: Column, last: Column) -> Column:
    """The characters from first to last (exclusive), as far as the text goes."""
    begin = F.greatest(F.lit(0), first)
    return F.substring(text, begin + 1, F.greatest(F.lit(0), F.least(F.length(text), last) - begin))


def around(text: Column, found: Column, before: int, after: int) -> Column:
    """The text around each spot: from `before` characters ahead of its start to `after` behind that. Windows may overlap."""
    return F.transform(found, lambda s: cut(text, s["start"] - before, s["start"] + after))
