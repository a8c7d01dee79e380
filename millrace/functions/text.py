"""Text columns. "" is this library's null for text: every function gives "" for null."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.entities import unescape

Text = Column | str

_SPACES = r"[\s\p{Z}]+"
_SEPARATING = r"[\p{P}\p{S}\s]+"
#: The commonest entities, which built-in functions decode.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&amp;": "&"}
#: What these do not do: characters beyond printable ASCII, and other entities. Searched for, as a pattern of whole texts
#: would need a stack as deep as the text is long.
_HARD = r"[^\x20-\x7E\t\n\r]|&(?!(?:" + "|".join(e[1:-1] for e in ENTITIES) + r");)[A-Za-z#]"


def _folding() -> tuple[str, str, str]:
    """Of Latin, Greek, Cyrillic and full-width forms: letters, the one base letter that each becomes without its marks, and all marks."""
    pairs = []
    for i in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        base = [x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != chr(i):
            pairs.append((chr(i), base[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), marks


_FROM, _TO, _MARKS = _folding()
#: Other characters than translate() can fold, which are those above, and letters without marks of the same scripts, dashes and quotes.
_UNFOLDABLE = r"[^\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0300-\u0377\u0386-\u03CE\u0400-\u0481\u048A-\u0529\u2010\u2012-\u2016\u2018-\u201F\u2022\uFF01-\uFF5E]"


def column(c: Text) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _mapped(c: Column, fn) -> Column:
    """fn on each text, by an Arrow-batched function; only texts that need it should be given."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return run(c)


def decoded(c: Text) -> Column:
    """All character references decoded, by built-in functions."""
    return unescape(column(c))


def collapse(c: Text) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(column(c), _SPACES, " "))


def plain_text(c: Text) -> Column:
    """Character references decoded and white space collapsed; characters stay as they are."""
    return collapse(decoded(c))


def clean_text(c: Text) -> Column:
    """Character references decoded, composed (NFKC), white space collapsed. Texts of printable ASCII need built-in functions
    only; others pass an Arrow-batched function."""
    c = column(c)
    easy = ~c.rlike(_HARD)
    common = c
    for entity, character in ENTITIES.items():  # "&amp;" last, as each is decoded once
        common = F.replace(common, F.lit(entity), F.lit(character))
    return collapse(F.when(easy, common).otherwise(_mapped(F.when(~easy, c), lambda s: unicodedata.normalize("NFKC", html.unescape(s)))))


def _unmarked(s: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))


def unmarked(c: Text) -> Column:
    """Decomposed (NFKD), without accents and other marks: letters of Latin, Greek and Cyrillic and full-width forms by a built-in
    function, texts with other characters by an Arrow-batched one."""
    c = column(c)
    easy = ~c.rlike(_UNFOLDABLE)
    return F.when(easy, F.translate(c, _FROM + _MARKS, _TO)).otherwise(_mapped(F.when(~easy, c), _unmarked))


def fold(c: Text) -> Column:
    """Case folded and without accents."""
    sharp = F.replace(F.replace(column(c), F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))
    return F.replace(F.lower(unmarked(sharp)), F.lit("ς"), F.lit("σ"))


def search_key(c: Text) -> Column:
    """Cleaned, folded, with the separating marks - _ / | , : ; · • as blanks."""
    return F.trim(F.regexp_replace(fold(clean_text(c)), r"[\s\-_/|,:;·•]+", " "))


def search_text(c: Text) -> Column:
    """In lower case, decomposed and without accents, with all punctuation and symbols as blanks: what the faceted search
    compares. One folding for every search."""
    return F.trim(F.regexp_replace(F.lower(unmarked(c)), _SEPARATING, " "))


def with_search_text(df: DataFrame, c: str, name: str) -> DataFrame:
    """Adds search_text(c). Only rows whose text built-in functions cannot fold are read by Python; the table is read once for
    these and once for the others, so use it where texts are long and few are hard, and search_text itself elsewhere."""
    easy = ~column(c).rlike(_UNFOLDABLE)
    plain = F.trim(F.regexp_replace(F.lower(F.translate(column(c), _FROM + _MARKS, _TO)), _SEPARATING, " "))
    return df.where(easy).withColumn(name, plain).unionByName(df.where(~easy).withColumn(name, search_text(c)))


def without_tags(c: Text) -> Column:
    return F.regexp_replace(column(c), r"<[^>]*>", " ")


def strip_tags(c: Text) -> Column:
    """Markup removed, character references decoded, composed, white space collapsed."""
    return clean_text(without_tags(c))


def name_key(c: Text) -> Column:
    """Folded name with & as "and" and all else but letters and digits as blanks."""
    return F.trim(F.regexp_replace(F.replace(fold(c), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))


def bounded(c: Text, most: int) -> Column:
    return F.substring(collapse(c), 1, most)


def slug_title(url: Text) -> Column:
    """The last part of an address's path as a title."""
    path = F.regexp_replace(F.regexp_replace(column(url), r"[?#].*$", ""), r"/+$", "")
    return F.initcap(collapse(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[-_+]+|\.html?$", " ")))


def strip_suffixes(c: Text, patterns: list[str]) -> Column:
    """All trailing patterns removed, each after blanks or a separating mark; the first word always stays."""
    any_of = "|".join(f"(?:{p})" for p in patterns)
    return F.regexp_replace(collapse(c), f"(?i)(?:[\\s|\\-_–—:]+(?:{any_of}))+\\s*$", "")


def natural_key(c: Text, collation: str | None = "UNICODE_CI_AI") -> Column:
    """Sorts without regard to case and accents, with numbers by value (runs of up to 20 digits)."""
    pieces = F.regexp_extract_all(column(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p))
    key = F.array_join(padded, "")
    return F.collate(key, collation) if collation else key
