"""Web addresses as columns. Unusable ones are ""."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.positions import let
from millrace.functions.text import collapse, column, plain_text

#: Query keys that name a variant.
VARIANT_KEYS = ["variant", "attribute_pa_size", "attribute_size", "variation_id"]
#: Query keys of analytics.
TRACKING_KEYS = ["_hsenc", "_hsmi", "dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid"]
#: Query keys of addresses that expire or carry credentials.
EXPIRING_KEYS = ["access_token", "auth", "authorization", "awsaccesskeyid", "expires", "expiration", "expiry", "key-pair-id", "policy", "sig", "signature", "token"]
EXPIRING_PREFIXES = "^(?:x-amz-|x-goog-|x-oss-)"

_ADDRESS = r"^(?i)(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(c: Column | str, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(column(c), _ADDRESS, i)


def scheme(c: Column | str) -> Column:
    return F.lower(part(c, 1))


def host(c: Column | str) -> Column:
    """Lower case, without user, port and a leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(c, 2)), r"^.*@|:\d*$", ""), r"^www\.", "")


def tidy_path(c: Column | str) -> Column:
    """Without doubled and trailing slashes; "/" for none."""
    path = F.regexp_replace(F.regexp_replace(part(c, 3), "/{2,}", "/"), "/+$", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def query_pairs(c: Column | str) -> Column:
    """The query's pairs as "key=value" in order of text."""
    pairs = F.filter(F.split(part(c, 4), "&"), lambda p: p != "")
    return F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))


def _key(pair: Column) -> Column:
    return F.lower(F.substring_index(pair, "=", 1))


def _put(c: Column | str, pairs: Column) -> Column:
    query = F.array_join(pairs, "&")
    whole = F.concat(scheme(c), F.lit("://"), F.lower(part(c, 2)), tidy_path(c), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(part(c, 1) == "", F.lit("")).otherwise(whole)


def product_address(c: Column | str) -> Column:
    """Canonical, without query and fragment."""
    return _put(c, F.array().cast("array<string>"))


def _form(c: Column) -> Column:
    """Decoded and encoded again, so that equal values are spelled the same way."""
    decoded = F.coalesce(F.try_url_decode(c), c)
    return F.replace(F.replace(F.url_encode(decoded), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def variant_address(c: Column | str) -> Column:
    """Canonical, of the query only what names a variant and has a value, in order of key and value."""
    kept = F.filter(query_pairs(c), lambda p: _key(p).isin(VARIANT_KEYS) & ~p.endswith("="))
    pairs = F.transform(kept, lambda p: F.struct(_form(F.substring_index(p, "=", 1)).alias("k"), _form(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    return _put(c, F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], F.lit("="), p["v"])))


def detail_target(c: Column | str) -> Column:
    """Where a product's own page lies: without fragment, and on product paths without query; other texts as they are."""
    path = part(c, 3)
    root = F.concat(scheme(c), F.lit("://"), part(c, 2), F.when(path == "", F.lit("/")).otherwise(path))
    query = F.when((part(c, 4) == "") | F.lower(path).rlike("/(?:products?|shop)/"), F.lit("")).otherwise(F.concat(F.lit("?"), part(c, 4)))
    bounded = F.substring(collapse(c), 1, 1000)
    return F.when(part(c, 1) == "", bounded).otherwise(F.concat(root, query))


def expiring(c: Column | str) -> Column:
    """Signed, expiring or with credentials: no lasting reference."""
    keys = F.transform(query_pairs(c), _key)
    return part(c, 2).contains("@") | F.exists(keys, lambda k: k.isin(EXPIRING_KEYS) | k.rlike(EXPIRING_PREFIXES)) | (F.array_contains(keys, "se") & F.array_contains(keys, "sv"))


def document_address(c: Column | str) -> Column:
    """Canonical, the query without analytics; "" for expiring ones."""
    kept = F.filter(query_pairs(c), lambda p: ~_key(p).isin(TRACKING_KEYS) & ~_key(p).startswith("utm_"))
    return F.when(expiring(c), F.lit("")).otherwise(_put(c, kept))


def public(c: Column | str) -> Column:
    """An http(s) address of at most 4096 characters without user, and not of this machine or a bare number."""
    h = host(c)
    return (part(c, 1) != "") & (F.length(column(c)) <= 4096) & ~part(c, 2).contains("@") & (h != "localhost") & ~h.rlike(r"^[\d.]+$|^\[") & h.contains(".")


def joined(base: Column | str, link: Column | str) -> Column:
    """A link of a page as a full address: full, //host, /path or path beside the page."""
    base = column(base)
    root = F.concat(scheme(base), F.lit("://"), part(base, 2))
    beside = F.regexp_replace(part(base, 3), "[^/]*$", "")
    return let(plain_text(link), lambda link: (
        F.when(link.rlike("^(?i)https?://"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:|^#|^$"), F.lit(""))
        .otherwise(F.concat(root, F.when(beside == "", F.lit("/")).otherwise(beside), link))
    ))
