"""Public addresses in one spelling: hosts as IDNA, no address of a private network, dot segments folded, query in order.

Parts are columns, one after another, so each is worked out once. Hosts with letters beyond ASCII and numeric hosts pass an
Arrow-batched function, as IDNA and the registry of address ranges are no built-in functions; all else is built in.
"""

from __future__ import annotations

import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.addresses import joined
from millrace.functions.text import column

#: Query keys of campaigns, and hosts of this machine.
CAMPAIGN_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
OWN_HOSTS = ["localhost", "localhost.localdomain"]
#: Characters that stay as they are in a path, and where an authority's host ends.
_IN_PATH = r"[A-Za-z0-9_.\-~/%:@!$&'()*+,;=]"
_AUTHORITY = r"^(?:(\[[^\]@]*\])|([^:@\[\]]*))(?::(\d*))?$"


def checked_host(host: str) -> str:
    """The host as it is written in an address, "" if it is none of the public."""
    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        if host.startswith("[") or "." not in host or any(c in "/?#@:" for c in unicodedata.normalize("NFKC", host)):
            return ""
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return ""
    if not ip.is_global:
        return ""
    return f"[{ip.compressed}]" if ip.version == 6 else ip.compressed


@F.pandas_udf(T.StringType())
def _checked(hosts: pd.Series) -> pd.Series:
    return hosts.map(checked_host, na_action="ignore")


def _host(h: Column) -> Column:
    hard = h.rlike(r"[^\x00-\x7F]|^[0-9.]+$|^\[")
    labels = F.split(h, r"\.")
    named = (F.size(labels) > 1) & F.forall(labels, lambda x: F.length(x).between(1, 63)) & ~h.isin(OWN_HOSTS) & ~h.endswith(".localhost")
    return F.when(hard, _checked(F.when(hard, h))).when(named, h).otherwise("")


def folded(path: Column) -> Column:
    """A path without empty and dot segments, each ".." taking the segment before it; two slashes at the start stay two."""
    keep = lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s))
    inner = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), keep), "/")
    return F.concat(F.when(path.rlike("^//(?!/)"), "//").otherwise("/"), inner)


def quoted(path: Column) -> Column:
    """Other characters than a path may hold as their bytes in percent."""
    each = F.transform(F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(_IN_PATH), c).when(c == " ", "%20").otherwise(F.url_encode(c)))
    return F.when(path.rlike(rf"^{_IN_PATH}*$"), path).otherwise(F.array_join(each, ""))


def _read(c: Column) -> Column:
    """A part of a query decoded; what is no escape stays."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _written(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_in_order(query: Column) -> Column:
    """The pairs of a query without those of campaigns, in order of key and value, each spelled one way."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    read = F.transform(pairs, lambda p, i: F.struct(_read(F.substring_index(p, "=", 1)).alias("k"), _read(F.regexp_replace(p, "(?s)^[^=]*=?", "")).alias("v"), i.alias("i")))
    kept = F.filter(read, lambda x: ~F.lower(x["k"]).isin(CAMPAIGN_KEYS))
    order = F.array_sort(F.transform(kept, lambda x: F.struct(F.lower(x["k"]).alias("low"), x["v"], x["i"], x["k"])))
    return F.array_join(F.transform(order, lambda x: F.concat(_written(x["k"]), F.lit("="), _written(x["v"]))), "&")


def public_addresses(df: DataFrame, address: str, name: str = "public", base: str | None = None, hosts: list[str] | None = None) -> DataFrame:
    """Adds the public spelling of each address, "" for those that are refused: of another scheme than http(s), with a user, a
    bad port, without a host or with one of this machine, of one label or of a range that is not global, or outside `hosts`
    and their subdomains, which must be public themselves. Null: "". Relative links are joined to the base."""
    value = F.regexp_replace(F.btrim(column(address), F.lit(" \t\r\n\f\x0b")), r"[\t\r\n]", "")
    rows = df.withColumn("__a", joined(base, value) if base else value)
    shape = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    rows = rows.withColumns({f"__{n}": F.regexp_extract("__a", shape, i) for i, n in enumerate(("scheme", "authority", "path", "query"), 1)})
    rows = rows.withColumns({"__scheme": F.lower("__scheme"), **{f"__h{i}": F.regexp_extract("__authority", _AUTHORITY, i) for i in (1, 2, 3)}})
    rows = rows.withColumns({"__port": F.col("__h3").try_cast("int"), "__plain": F.lower(F.rtrim(F.trim(F.concat("__h1", "__h2")), F.lit(".")))})
    rows = rows.withColumn("__host", _host(F.col("__plain")))
    if hosts:
        own = [checked_host(h.rstrip(".").lower()) for h in hosts]
        if "" in own:
            raise ValueError(f"no public host: {hosts[own.index('')]}")
        inside = F.col("__host").isin(own)
        for h in own:
            inside = inside | F.col("__host").endswith("." + h)
        rows = rows.withColumn("__host", F.when(inside, F.col("__host")).otherwise(""))
    usual = F.when(F.col("__scheme") == "http", 80).otherwise(443)
    port = F.when(F.col("__port").isNotNull() & (F.col("__port") != 0) & (F.col("__port") != usual), F.concat(F.lit(":"), "__port")).otherwise("")
    rows = rows.withColumns({"__folded": folded(F.when(F.col("__path") == "", "/").otherwise(F.col("__path"))), "__pairs": query_in_order(F.col("__query"))})
    path = quoted(F.col("__folded"))
    slash = F.when(F.col("__path").endswith("/") & ~F.col("__folded").endswith("/"), "/").otherwise("")
    query = F.when(F.col("__pairs") != "", F.concat(F.lit("?"), "__pairs")).otherwise("")
    bad = (F.col("__scheme") == "") | (F.col("__host") == "") | ((F.col("__h3") != "") & ~F.coalesce(F.col("__port") <= 65535, F.lit(False)))
    whole = F.concat("__scheme", F.lit("://"), "__host", port, path, slash, query)
    return rows.withColumn(name, F.when(bad, "").otherwise(whole)).drop(*(c for c in rows.columns if c.startswith("__") and c not in df.columns))
