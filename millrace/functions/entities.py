"""Character references of HTML decoded by built-in functions, with the result that Python's html.unescape has."""

from __future__ import annotations

import html.entities
import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference (the first branch), text without one, or an ampersand that begins none.
_PIECES = r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
#: Names that count without a semicolon, also at the start of longer words; the longest first.
_SHORT = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_REPLACED = "�"


def _by_number() -> dict[str, str]:
    """What numbers stand for that do not stand for their code point: 0, and those of Windows' Latin letters."""
    table = {"0": _REPLACED, "13": "\r"}
    for n in range(0x80, 0xA0):
        try:
            table[str(n)] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            table[str(n)] = chr(n)
    return table


def _found(table: dict[str, str], key: Column) -> Column:
    """A key's value in a literal table, null if it has none. Keys are dealt to buckets by CRC-32, as Spark searches a map from its
    first entry on; the optimizer folds the table once."""
    buckets: list[dict[str, str]] = [{} for _ in range(max(1, len(table) // 8))]
    for k, v in table.items():
        buckets[zlib.crc32(k.encode()) % len(buckets)][k] = v
    own = F.get(F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>"), (F.crc32(key.cast("binary")) % len(buckets)).cast("int"))
    return F.try_element_at(own, key)


def _character(code: Column) -> Column:
    """The character of a code point; none for those that are no characters, U+FFFD for what is no code point."""
    none = code.between(1, 8) | code.isin(0xB, 0x7F) | code.between(0xE, 0x1F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    known = _found(_by_number(), code.cast("string"))
    wrong = code.isNull() | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(wrong, F.lit(_REPLACED)).when(known.isNotNull(), known).when(none, F.lit("")).otherwise(own)


def _piece(p: Column) -> Column:
    name = F.substr(p, F.lit(2))
    whole = _found(dict(html.entities.html5), name)
    short = F.regexp_extract(name, "^(" + "|".join(_SHORT) + ")", 1)
    rest = F.substr(name, F.length(short) + 1)
    begun = F.when(short != "", F.concat(_found({n: html.entities.html5[n] for n in _SHORT}, short), rest)).otherwise(p)
    digits, digits16 = F.regexp_extract(p, "^&#([0-9]+)", 1), F.regexp_extract(p, "^&#[xX]0*([0-9a-fA-F]+)", 1)
    code16 = F.when(F.length(digits16) <= 8, F.conv(digits16, 16, 10).try_cast("long"))
    return (
        F.when(~p.startswith("&") | (p == "&"), p).when(digits != "", _character(digits.try_cast("long"))).when(digits16 != "", _character(code16))
        .otherwise(F.coalesce(whole, begun))
    )


def unescape(c: Column) -> Column:
    """All character references decoded, each once. Texts without an ampersand are not touched."""
    return F.get(F.transform(F.array(c), lambda t: F.when(~t.contains("&"), t).otherwise(F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PIECES), F.lit(0)), _piece), ""))), F.lit(0))
