"""Nested records, public views, set operations, times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import digest
from millrace.operators import records
from millrace.operators.segments import offsets
from millrace.plans.registry import query
from millrace.sources.tables import table


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS product_id, o_orderkey || '-' || v AS variant_id, CASE WHEN v = 0 THEN o_orderpriority ELSE o_orderpriority || ' - ' || o_orderstatus END AS name, CAST(o_orderkey % 90 + v AS DOUBLE) AS price, v = 1 AS available
FROM orders, (VALUES (0), (1)) t(v) WHERE o_orderkey % 7 <> 3""")
def feed_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Product feeds in JSON to one row a variant; broken JSON gives none."""
    v = F.array(*(F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit(f"-{i}")).alias("id"), (F.lit("Default Title") if i == 0 else F.col("o_orderstatus")).alias("title"), (F.col("o_orderkey") % 90 + i).cast("string").alias("price"), F.lit(i == 1).alias("available")) for i in (0, 1)))
    feed = F.to_json(F.struct(F.array(F.struct(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("h").alias("handle"), v.alias("variants"))).alias("products")))
    feeds = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 3, F.lit("{broken")).otherwise(feed).alias("payload"))
    return records.feed_rows(feeds, "o_orderkey", "payload")


@query("""SELECT o_orderkey, CAST(o_orderkey * 100 + 99 AS DOUBLE) / CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END AS units, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey >= 1000 THEN CAST(o_orderkey AS DOUBLE) / 100 ELSE CAST(o_orderkey AS DOUBLE) END AS repaired FROM orders""")
def minor_unit_prices(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", records.minor_units((k * 100 + 99).cast("string"), (k % 3).cast("int")).alias("units"), records.repaired_price(k.cast("string"), k % 2 == 0).alias("repaired"))


@query("""SELECT c_custkey, CAST((CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS missing, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS c_name FROM customer""")
def public_view(spark: SparkSession, folder: str) -> DataFrame:
    """Placeholders count as missing; names of controlled rows are hidden."""
    k = F.col("c_custkey")
    df = table(spark, folder, "customer").select("c_custkey", records.missing_score(F.when(k % 4 == 0, " N/A ").otherwise("x"), F.when(k % 5 != 0, F.lit("y"))).alias("missing"), "c_name")
    return records.hidden(df, k % 6 == 0, ["c_name"])


@query("""SELECT source, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 12""")
def top_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve longest documents of each source (a top-k report)."""
    d = table(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return records.first_per_key(d, "source", [F.desc("n_chars"), F.asc("doc_id")], 12).select("source", "doc_id", "place")


@query("""SELECT outcome, count(*) AS rows FROM (SELECT CASE WHEN event_type = 'purchase' OR value > 20 THEN 'kept' WHEN event_type = 'view' THEN 'failure' WHEN value > 5 THEN 'kept_by_detail' ELSE 'rejected' END AS outcome FROM events) GROUP BY outcome""")
def verification_routes(spark: SparkSession, folder: str) -> DataFrame:
    detail = F.when(F.col("event_type") != "view", F.coalesce(F.col("value") > 5, F.lit(False)))
    e = table(spark, folder, "events").select(records.routed(F.col("event_type") == "purchase", F.coalesce(F.col("value") > 20, F.lit(False)), detail).alias("outcome"))
    return e.groupBy("outcome").agg(F.count("*").alias("rows"))


@query("""(SELECT o_custkey AS key, 'gone' AS side FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey, 'gone' FROM orders WHERE o_orderstatus = 'O')
UNION ALL (SELECT o_custkey, 'new' FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey, 'new' FROM orders WHERE o_orderstatus = 'F')""")
def set_equality(spark: SparkSession, folder: str) -> DataFrame:
    """What each of two bags has beyond the other."""
    o = table(spark, folder, "orders")
    f, n = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key")) for s in ("F", "O"))
    return f.exceptAll(n).withColumn("side", F.lit("gone")).unionByName(n.exceptAll(f).withColumn("side", F.lit("new")))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS profile, max(ts) AS generated_at, count(*) AS payloads FROM events GROUP BY user_id""")
def profile_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The latest payload of each key wins; the time is the latest of all."""
    return table(spark, folder, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("profile"), F.max("ts").alias("generated_at"), F.count("*").alias("payloads"))


@query("""SELECT user_id, substr(sha256(array_to_string(list_sort(list_distinct(list(event_type))), chr(31))), 1, 32) AS signature FROM events GROUP BY user_id""")
def drift_signature(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of the sorted set of a route's signals (a handful of kinds)."""
    s = table(spark, folder, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    return s.select("user_id", digest(F.array_join("s", "\x1f"), length=32).alias("signature"))


@query("""SELECT event_id, date_trunc('second', ts) AS at, ts > TIMESTAMP '2024-01-30 23:59:00' AS ahead, ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 MINUTE AS stale FROM events""")
def age_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as times, seconds kept; older than thirty minutes is stale, too far ahead is refused."""
    e = table(spark, folder, "events").select("event_id", F.col("ts").cast("string").alias("t"))
    at = F.coalesce(F.try_to_timestamp("t"), F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return e.select("event_id", F.date_trunc("second", at).cast("timestamp_ntz").alias("at"), (at > F.lit("2024-01-30 23:59:00").cast("timestamp")).alias("ahead"), (at < F.expr("TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 MINUTES")).alias("stale"))


@query("""WITH o AS (SELECT p_brand, p_partkey, p_size, CAST(coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM part)
SELECT p_brand, count(*) AS visible, min(p_partkey) AS first FROM o WHERE top + p_size > 200 AND top < 600 GROUP BY p_brand""")
def visible_range(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a window of a scrolled list shows, by running heights."""
    p = offsets(table(spark, folder, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.col("p_partkey")], F.col("p_size"), "top")
    return p.where((F.col("top") + F.col("p_size") > 200) & (F.col("top") < 600)).groupBy("p_brand").agg(F.count("*").alias("visible"), F.min("p_partkey").alias("first"))


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS version, o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS unchanged FROM orders""")
def adapter_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of each route's entries, and which equal the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("version"), (F.col("o_orderstatus") == F.lag("o_orderstatus").over(w)).alias("unchanged"))
