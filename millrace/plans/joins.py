"""Joins, set operations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import matching, reports
from millrace.operators.ranking import top_with_ties
from millrace.plans.registry import query
from millrace.sources.tables import table
from millrace.streaming import health


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey
UNION SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_orderkey = c_custkey""")
def any_key_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two keys that either one may agree by: both become rows of one equi-join; a pair found twice is one."""
    c = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("k1"), F.concat(F.lit("o"), "c_custkey").alias("k2"))
    o = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("j1"), F.concat(F.lit("o"), "o_orderkey").alias("j2"))
    return matching.by_any_key(c, o, ["k1", "k2"], ["j1", "j2"], "o_orderkey").select("c_custkey", "o_orderkey")


_SCORED = """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_partkey, 5 + CASE WHEN p_partkey = l_partkey THEN 500 ELSE 0 END + CASE WHEN abs(p_size - l_quantity) <= 1 THEN 80 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 45 ELSE 0 END AS score
 FROM lineitem JOIN part ON p_partkey // 8 = l_partkey // 8 WHERE NOT (abs(p_size - l_quantity) > 20) AND (p_partkey = l_partkey OR abs(p_size - l_quantity) <= 5)), """
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    i, p = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), table(spark, folder, "part").select("p_partkey", "p_size", "p_type")
    pairs = i.withColumn("block", (F.col("l_partkey") / 8).cast("long")).join(p.withColumn("block", (F.col("p_partkey") / 8).cast("long")), "block")
    gap = F.abs(F.col("p_size") - F.col("l_quantity"))
    points = [("same block", F.lit(True), 5), ("exact id", F.col("p_partkey") == F.col("l_partkey"), 500), ("weight", gap <= 1, 80), ("kind", F.col("p_type") == "PROMO", 45)]
    return matching.scored(pairs, gap > 20, points, (F.col("p_partkey") == F.col("l_partkey")) | (gap <= 5))


@query(_SCORED + f"r AS (SELECT *, max(score) OVER (PARTITION BY {_KEYS}) AS top FROM t) SELECT DISTINCT {_KEYS}, p_partkey, CAST(score AS INTEGER) AS score FROM r WHERE score = top")
def scored_match(spark: SparkSession, folder: str) -> DataFrame:
    """The best candidates of each row within its block: conflicts go, points add up, ties stay."""
    return top_with_ties(_pairs(spark, folder), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "score", ["p_partkey"])


@query(_SCORED + """u AS (SELECT DISTINCT l_partkey, p_partkey, max(score) OVER (PARTITION BY l_partkey, p_partkey) AS score FROM t), r AS (SELECT *, max(score) OVER (PARTITION BY l_partkey) AS top FROM u)
SELECT l_partkey, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey, CAST(max(score) AS INTEGER) AS score, count(*) AS rivals, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM r WHERE score = top GROUP BY l_partkey""")
def ambiguous_match(spark: SparkSession, folder: str) -> DataFrame:
    """One decision a product: the candidate of highest score, none where several share it."""
    best = _pairs(spark, folder).groupBy("l_partkey", "p_partkey").agg(F.max("score").alias("score"))
    return matching.decide(best, ["l_partkey"], "p_partkey")


@query("""SELECT s_suppkey, coalesce(n_name, 'uncertain') AS nation, coalesce(r_name, 'uncertain') AS region FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def profile_left(spark: SparkSession, folder: str) -> DataFrame:
    s, n, r = table(spark, folder, "supplier"), table(spark, folder, "nation").where("n_nationkey % 4 <> 0"), table(spark, folder, "region")
    j = s.join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return j.select("s_suppkey", F.coalesce("n_name", F.lit("uncertain")).alias("nation"), F.coalesce("r_name", F.lit("uncertain")).alias("region"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, p) AS segment, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END, b) AS balance FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p, max(o_totalprice) AS b FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def fill_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps of one table filled from another; nothing overwritten, no row lost."""
    c = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("balance"))
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("segment"), F.max("o_totalprice").alias("balance"))
    return matching.fill(c, o, "c_custkey", ["segment", "balance"])


@query("""WITH cur AS (SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-25'), prev AS (SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-05' AND event_type = 'purchase'), ok AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-03')
SELECT event_id, user_id, false AS stale FROM cur UNION ALL SELECT event_id, user_id, true FROM prev WHERE user_id NOT IN (SELECT user_id FROM cur) AND user_id NOT IN (SELECT user_id FROM ok)""")
def carry_forward_stale(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    current = e.where("ts >= TIMESTAMP '2024-01-25'").select("event_id", "user_id")
    previous = e.where("ts < TIMESTAMP '2024-01-05' AND event_type = 'purchase'").select("event_id", "user_id")
    return matching.carry_forward(current, previous, "user_id", e.where("event_type = 'signup' AND ts < TIMESTAMP '2024-01-03'"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE 'A%')")
def admitted_semi(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").join(table(spark, folder, "region").where("r_name LIKE 'A%'"), F.col("r_regionkey") == F.col("n_regionkey"))
    return table(spark, folder, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("s_suppkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def coverage_anti(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").join(table(spark, folder, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) AND doc_id % 2 = 0)""")
def index_parity(spark: SparkSession, folder: str) -> DataFrame:
    return matching.parity(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels").select("doc_id"), "doc_id")


@query("""SELECT l.doc_id, CASE WHEN d.lang = 'en' AND l.quality = 1 THEN 'kept' WHEN d.lang <> 'en' THEN 'other_scope' WHEN l.toxic = 1 THEN 'rejected' ELSE 'low_quality' END AS outcome, abs(d.n_chars - 1000) <= 250 AS near FROM labels l JOIN documents d USING (doc_id)""")
def scope_join_reasons(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    outcome = F.when((F.col("lang") == "en") & (F.col("quality") == 1), "kept").when(F.col("lang") != "en", "other_scope").when(F.col("toxic") == 1, "rejected").otherwise("low_quality")
    return j.select("doc_id", outcome.alias("outcome"), (F.abs(F.col("n_chars") - 1000) <= 250).alias("near"))


@query("""SELECT 'balance' AS field, count(*) FILTER (WHERE c_acctbal > 0) AS populated, count(*) FILTER (WHERE NOT c_acctbal > 0) AS missing, CAST(round(CAST(count(*) FILTER (WHERE c_acctbal > 0) * 1000000 AS DECIMAL(38,6)) / count(*)) AS DOUBLE) / 1000000 AS ratio FROM customer
UNION ALL SELECT 'segment', count(*) FILTER (WHERE c_mktsegment LIKE 'A%'), count(*) FILTER (WHERE NOT c_mktsegment LIKE 'A%'), CAST(round(CAST(count(*) FILTER (WHERE c_mktsegment LIKE 'A%') * 1000000 AS DECIMAL(38,6)) / count(*)) AS DOUBLE) / 1000000 FROM customer""")
def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.coverage(table(spark, folder, "customer"), [("balance", F.col("c_acctbal") > 0), ("segment", F.col("c_mktsegment").startswith("A"))])


@query("""WITH m AS (SELECT count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS pos_ok, count(*) FILTER (WHERE quality = 0) AS neg FROM labels)
SELECT 'positive_present' AS gate, CAST(pos AS DOUBLE) AS measured, pos > 0 AS passed FROM m UNION ALL SELECT 'negative_present', CAST(neg AS DOUBLE), neg > 0 FROM m
UNION ALL SELECT 'recall', CAST((2 * pos_ok * 100000 + pos) // (2 * pos) AS DOUBLE) / 1000, pos_ok * 100 >= 98 * pos FROM m""")
def certification_gates(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "labels").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("ok"), F.count_if(F.col("quality") == 0).alias("neg"))
    recall = F.round(F.col("ok").cast("decimal(20,6)") * 100 / F.col("pos"), 3)
    return reports.gate_rows(m, [("positive_present", F.col("pos"), F.col("pos") > 0), ("negative_present", F.col("neg"), F.col("neg") > 0), ("recall", recall, F.col("ok") * 100 >= F.col("pos") * 98)])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = least(CAST(floor(n * 0.5) AS BIGINT), n - 1) THEN value END) AS p50, max(CASE WHEN i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN value END) AS p95 FROM r GROUP BY event_type""")
def percentile_floor(spark: SparkSession, folder: str) -> DataFrame:
    return reports.floor_percentile(table(spark, folder, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""SELECT 'line_twice' AS "check", l_orderkey || '-' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'no_order', CAST(l_orderkey AS VARCHAR) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'price_not_positive', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice < 5000""")
def violations(spark: SparkSession, folder: str) -> DataFrame:
    i, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    twice = i.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    orphans = i.select("l_orderkey").distinct().join(o.where("o_orderstatus <> 'P'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return reports.violations([("line_twice", twice, F.concat_ws("-", "l_orderkey", "l_linenumber")), ("no_order", orphans, F.col("l_orderkey")), ("price_not_positive", o.where("o_totalprice < 5000"), F.col("o_orderkey"))])


_STATES = """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed, value > 100 AS signal, event_type = 'error' AND value > 150 AS hard, event_type = 'view' AND value > 200 AS blocked,
 CASE WHEN event_type = 'signup' AND value > 250 THEN 1 ELSE 0 END AS retire FROM events),
r AS (SELECT *, sum(1 - failed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
f AS (SELECT *, CAST(sum(failed) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM r),
s AS (SELECT *, CASE WHEN max(retire) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 THEN 'retired' WHEN coalesce(blocked, false) THEN 'blocked'
 WHEN coalesce(hard, false) OR failures >= 2 THEN 'quarantined' WHEN coalesce(signal, false) THEN 'degraded' ELSE 'healthy' END AS state FROM f)"""


def _states(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind, value = F.col("event_type"), F.col("value")
    order = [F.col("ts"), F.col("event_id")]
    return health.next_state(e, ["user_id"], order, kind == "error", value > 100, (kind == "error") & (value > 150), (kind == "view") & (value > 200), (kind == "signup") & (value > 250))


@query(_STATES + " SELECT user_id, event_id, failures, state FROM s")
def event_state_machine(spark: SparkSession, folder: str) -> DataFrame:
    return _states(spark, folder).select("user_id", "event_id", "failures", "state")


@query(_STATES + """, p AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'probing') AS before FROM s)
SELECT user_id, event_id, before AS from_state, state AS to_state FROM p WHERE (before = 'quarantined' AND state IN ('healthy', 'degraded')) OR (before = 'blocked' AND state IN ('healthy', 'degraded'))""")
def invalid_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Steps that the table of transitions does not allow."""
    return health.invalid_steps(_states(spark, folder), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "from_state", "to_state")


@query("""SELECT user_id, event_type, count(*) AS attempts, arg_max(value >= 5, (ts, event_id)) AS recovered, count(*) FILTER (WHERE NOT value >= 5) AS failures FROM events GROUP BY user_id, event_type""")
def retry_terminal(spark: SparkSession, folder: str) -> DataFrame:
    """The last attempt of each route decides."""
    e = table(spark, folder, "events")
    return reports.latest_attempts(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], F.col("value") >= 5)


@query("""SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS healthy, count(*) FILTER (WHERE event_type = 'error') AS failing, least(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 100000) AS failure_sum, bool_or(event_type = 'signup') AS fallback FROM events GROUP BY user_id""".replace("least(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 100000)", "CAST(least(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 100000) AS BIGINT)"))
def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("healthy"), F.count_if(F.col("event_type") == "error").alias("failing"), F.least(F.sum(k), F.lit(100000)).alias("failure_sum"), F.bool_or(F.col("event_type") == "signup").alias("fallback"))


@query("""SELECT user_id, arg_max(event_type, (n, -i)) AS active FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS i FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type) GROUP BY user_id""")
def active_route(spark: SparkSession, folder: str) -> DataFrame:
    """The healthy route with most rows, the first of equals."""
    n = table(spark, folder, "events").where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("i"))
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("i"))).alias("active"))
