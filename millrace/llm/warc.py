"""Operator 5: not-modified revisits of a web archive, resolved to the response that they stand for.

Records are dealt by canonical address. Each revisit takes the latest earlier full response of its address (an as-of
join), its validators are checked against that response's, and the response's headers are updated by those that a
not-modified answer may carry. All of it is DataFrame functions.

The as-of join works in two steps, so that an address with a third of all records is no single task's work: within
(address, chunk of time) by a window, and between chunks by a window over one row a chunk. Payloads are not moved by it;
they are joined last, by record.

Ties: records of one time are ordered by record_id; a response is earlier if its (time, record_id) is less. Null or
unusable address: the record resolves to nothing ("no_address"). Null time: first. Null validators: the next one is
compared; none in common: "no_validator". Null or other kind: status "unknown_kind", no payload. Repeated rows: each gives
its row; responses of one record_id are one record, whose payload for revisits is the least. Empty table: no rows. Other
columns stay out.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from millrace.functions.addresses import document_address

#: The headers that a not-modified answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Seconds of a chunk of time; and of records without time the numbers of a chunk, or the characters that tell its texts apart.
CHUNK = 3_600
UNTIMED, UNTIMED_CHUNK, UNTIMED_CHARACTERS = -(1 << 62), 1 << 16, 3


def resolve(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """record_id, address, kind, status, source_id, headers, payload of all records (record_id, uri, at, kind, etag,
    last_modified, headers, payload); kind is response or revisit, at is in seconds, header names are in lower case."""
    slim = records.select("record_id", document_address("uri").alias("address"), F.coalesce(F.col("at").cast("long"), F.lit(UNTIMED)).alias("at"), "kind", "etag", "last_modified", "headers")
    # Records without time come in order of record_id; chunks rise with both.
    part, none = _record_chunk(records)
    slim = slim.withColumn("chunk", F.struct(F.floor(F.col("at") / chunk).alias("time"), F.when(F.col("at") == UNTIMED, part).otherwise(none).alias("record")))
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    within = Window.partitionBy("address", "chunk").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    revisits = slim.where("address <> ''").withColumn("near", F.last(full, ignorenulls=True).over(within)).where("kind = 'revisit'")
    latest = slim.where("address <> ''").groupBy("address", "chunk").agg(F.max_by(full, F.when(F.col("kind") == "response", F.struct("at", "record_id"))).alias("latest"))
    between = Window.partitionBy("address").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = latest.select("address", "chunk", F.last("latest", ignorenulls=True).over(between).alias("far"))
    found = revisits.join(earlier, ["address", "chunk"], "left").withColumn("source", F.coalesce("near", "far"))
    found = found.withColumn("status", _status("source")).withColumn("ok", F.col("status") == "resolved")
    merged = F.when(F.col("ok"), _merged(F.col("source.headers"), F.col("headers"))).otherwise(F.col("headers"))
    found = found.select("record_id", "address", "kind", "status", F.when(F.col("ok"), F.col("source.record_id")).alias("source_id"), merged.alias("headers"))
    payloads = records.where("kind = 'response'").groupBy(F.col("record_id").alias("source_id")).agg(F.min("payload").alias("payload"))
    resolved = found.join(payloads, "source_id", "left")
    responses = records.where("kind = 'response'").select("record_id", document_address("uri").alias("address"), "kind", F.lit("full").alias("status"), F.lit(None).cast(records.schema["record_id"].dataType).alias("source_id"), "headers", "payload")
    reason = F.when(F.coalesce(F.col("kind"), F.lit("")) != "revisit", "unknown_kind").otherwise("no_address")
    lost = slim.where("kind IS NULL OR kind NOT IN ('response', 'revisit') OR (address = '' AND kind = 'revisit')")
    lost = lost.select("record_id", "address", "kind", reason.alias("status"), F.lit(None).cast(records.schema["record_id"].dataType).alias("source_id"), "headers", F.lit(None).cast("string").alias("payload"))
    return resolved.select(responses.columns).unionByName(responses).unionByName(lost)


def _record_chunk(records: DataFrame) -> tuple[Column, Column]:
    """What deals records without time to chunks that rise with record_id, and its value for others: numbers by ranges, texts by
    UNTIMED_CHARACTERS beyond what they all begin with."""
    kind = records.schema["record_id"].dataType
    if isinstance(kind, IntegralType):
        return F.floor(F.col("record_id") / UNTIMED_CHUNK), F.lit(0).cast("long")
    if not isinstance(kind, StringType):
        return F.lit(0).cast("long"), F.lit(0).cast("long")
    ends = records.where("at IS NULL").agg(F.min("record_id"), F.max("record_id")).first()
    same = len(commonprefix([x or "" for x in ends]))
    return F.substring("record_id", 1, same + UNTIMED_CHARACTERS), F.lit("")


def _status(source: str) -> Column:
    same = F.coalesce(F.col("etag") == F.col(f"{source}.etag"), F.col("last_modified") == F.col(f"{source}.last_modified"))
    return F.when(F.col(source).isNull(), "no_earlier").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")


def _merged(stored: Column, new: Column) -> Column:
    """Stored headers, updated by the permitted ones of the revisit."""
    new = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(PERMITTED))
    stored = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of pages: each page's response at ten times its id, a revisit 5 s later and one 5 s before it."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    etag = F.md5(text)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("html"), etag.alias("tag"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("capture"))
    first = F.col("capture") == 0
    day = (F.col("page_id") % 7).cast("string")
    headers = F.when(first, F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), day, F.lit("etag"), F.col("tag"))).otherwise(F.create_map(F.lit("content-type"), F.lit("none"), F.lit("date"), F.concat(F.lit("re"), day), F.lit("expires"), F.lit("0")))
    return rows.select(
        (F.col("page_id") * 3 + F.col("capture")).alias("record_id"), F.when(first, F.col("url")).otherwise(F.concat("url", F.lit("#re"))).alias("uri"),
        (F.col("page_id") * 10 + F.when(first, 0).when(F.col("capture") == 1, 5).otherwise(-5)).alias("at"), F.when(first, "response").otherwise("revisit").alias("kind"),
        F.when(first | (F.col("page_id") % 3 != 0), F.col("tag")).alias("etag"), day.alias("last_modified"), headers.alias("headers"), F.when(first, F.col("html")).alias("payload"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every capture of every page: what it resolves to."""
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    page = F.floor(F.col("record_id") / 3).cast("long")
    return found.select(page.alias("page_id"), (F.col("record_id") % 3).cast("int").alias("capture"), "address", "status", F.floor(F.col("source_id") / 3).cast("long").alias("source_page_id"), F.sha2("payload", 256).alias("payload_sha256"), headers.alias("headers"))


OP5_SQL = r"""WITH a AS (SELECT page_id, coalesce(html, '') AS html, lower(regexp_extract(url, '^(https?)://', 1, 'i')) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1, 'i')) AS host,
 regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1, 'i'), '/{2,}', '/', 'g'), '/+$', '') AS path,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT lower(split_part(p, '=', 1)) LIKE 'utm\_%' ESCAPE '\')), '&') AS q FROM pages),
c AS (SELECT page_id, c.capture, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS address, page_id * 10 + CASE c.capture WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE -5 END AS t,
 CASE WHEN c.capture = 0 OR page_id % 3 <> 0 THEN md5(html) END AS etag, CAST(page_id % 7 AS VARCHAR) AS day, md5(html) AS tag, sha256(html) AS sha FROM a, (VALUES (0), (1), (2)) c(capture)),
s AS (SELECT *, last_value(CASE WHEN capture = 0 THEN {'p': page_id, 'etag': etag, 'day': day, 'sha': sha} END IGNORE NULLS) OVER (PARTITION BY address ORDER BY t, page_id * 3 + capture ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM c),
r AS (SELECT *, CASE WHEN capture = 0 THEN 'full' WHEN src IS NULL THEN 'no_earlier' WHEN coalesce(etag = src.etag, day = src.day) THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM s)
SELECT page_id, capture, address, status, CASE WHEN status = 'resolved' THEN src.p END AS source_page_id, CASE WHEN status = 'full' THEN sha WHEN status = 'resolved' THEN src.sha END AS payload_sha256,
 CASE status WHEN 'full' THEN 'content-type=text/html; date=' || day || '; etag=' || tag WHEN 'resolved' THEN 'content-type=text/html; date=re' || day || '; etag=' || src.etag || '; expires=0' ELSE 'content-type=none; date=re' || day || '; expires=0' END AS headers FROM r"""
