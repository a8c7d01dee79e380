"""Gates, prices, potency, best rows, duplicates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import drop_share, half_even, half_up, rating_pair, within
from millrace.operators import gates
from millrace.operators.ranking import best_of, best_row, filled, losers
from millrace.plans.registry import query
from millrace.sources.tables import table

# Exact half-up division of whole numbers in SQL: (2 * a + b) // (2 * b).


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
 CASE WHEN l_discount > 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(round(l_discount * 100) AS BIGINT) * 1000 - 3000 END AS original, CAST(l_quantity AS BIGINT) AS grams FROM lineitem),
u AS (SELECT * REPLACE (CASE WHEN price BETWEEN 1 AND 10000000 THEN price END AS price), CASE WHEN price BETWEEN 1 AND 10000000 AND original > price THEN original END AS kept FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(price AS DOUBLE) / 100 AS price, CAST(kept AS DOUBLE) / 100 AS original,
 CAST((2 * (kept - price) * 10000 + kept) // (2 * kept) AS DOUBLE) / 100 AS discount_percent,
 CAST((2 * price * 100 + grams) // (2 * grams) AS DOUBLE) / 10000 AS per_gram, CASE WHEN original < price THEN 'original_below_price' END AS warning FROM u""")
def price_fields(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "lineitem")
    original = F.when(F.col("l_discount") > 0, half_up(F.col("l_extendedprice").cast("decimal(18,2)") + F.col("l_discount").cast("decimal(18,2)") * 1000 - 30, 2))
    f = gates.price_fields(i, F.col("l_extendedprice"), original, F.col("l_quantity"))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "original", "discount_percent", "per_gram", "warning")


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DECIMAL(18,6)) + 0.5 END AS direct, CASE WHEN p_size % 3 = 0 THEN CAST(p_size * 0.03 AS DECIMAL(18,6)) END AS base,
 CASE WHEN p_size % 5 <> 0 THEN CAST(p_size * 2.9 AS DECIMAL(18,6)) END AS acid FROM part),
u AS (SELECT *, coalesce(CAST(direct AS DECIMAL(28,9)), CAST(base + CAST(acid * 0.877 AS DECIMAL(28,9)) AS DECIMAL(28,9)), CAST(acid * 0.877 AS DECIMAL(28,9))) AS v FROM t)
SELECT p_partkey, CASE WHEN v BETWEEN 0 AND 100 THEN CAST(round(v, 4) AS DOUBLE) END AS value, CASE WHEN v BETWEEN 0 AND 100 THEN CAST(round(v, 0) AS INTEGER) END AS display,
 CASE WHEN v < 0 OR v > 100 THEN 'rejected' WHEN direct IS NOT NULL THEN 'direct' WHEN base IS NOT NULL AND acid IS NOT NULL THEN 'calculated' WHEN acid IS NOT NULL THEN 'estimate' ELSE 'unavailable' END AS method FROM u""")
def potency_ladder(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size").cast("decimal(18,6)")
    direct, base, acid = F.when(F.col("p_size") % 4 == 0, size + F.lit("0.5").cast("decimal(18,6)")), F.when(F.col("p_size") % 3 == 0, size * F.lit("0.03").cast("decimal(3,2)")), F.when(F.col("p_size") % 5 != 0, size * F.lit("2.9").cast("decimal(2,1)"))
    return gates.potency(table(spark, folder, "part"), direct, base, acid).select("p_partkey", "value", "display", "method")


_RULES = """CASE WHEN o_orderpriority IS NULL OR trim(o_orderpriority) = '' THEN 'missing_name' WHEN o_custkey % 50 = 0 THEN 'missing_source' WHEN o_orderstatus = 'P' THEN 'not_explicitly_in_stock'
 WHEN o_totalprice <= 0 THEN 'invalid_price' WHEN o_totalprice > 450000 THEN 'price_out_of_range' WHEN o_orderpriority LIKE '%NOT SPECIFIED%' THEN 'unsupported_type' END"""


def _order_rules() -> gates.Rules:
    name = F.col("o_orderpriority")
    return [
        ("missing_name", name.isNull() | (F.trim(name) == "")), ("missing_source", F.col("o_custkey") % 50 == 0), ("not_explicitly_in_stock", F.col("o_orderstatus") == "P"),
        ("invalid_price", F.col("o_totalprice") <= 0), ("price_out_of_range", F.col("o_totalprice") > 450000), ("unsupported_type", name.contains("NOT SPECIFIED")),
    ]


@query(f"SELECT reason, count(*) AS rows FROM (SELECT {_RULES} AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY reason")
def quality_gate_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return gates.reason_counts(gates.split(table(spark, folder, "orders"), _order_rules())[1])


@query(f"SELECT o_orderkey, o_custkey FROM (SELECT *, {_RULES} AS reason FROM orders) WHERE reason IS NULL")
def quality_gate_admitted(spark: SparkSession, folder: str) -> DataFrame:
    return gates.split(table(spark, folder, "orders"), _order_rules())[0].select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_custkey % 50 = 0 THEN 'missing_source' END, CASE WHEN o_orderstatus = 'P' THEN 'not_explicitly_in_stock' END, CASE WHEN o_totalprice > 450000 THEN 'price_out_of_range' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders""")
def gate_all_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rules = [r for r in _order_rules() if r[0] in ("missing_source", "not_explicitly_in_stock", "price_out_of_range")]
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(gates.all_failing(rules), ",").alias("reasons"))


@query("""SELECT n_nationkey, n, CAST(active AS BIGINT) AS active, CAST(priced AS BIGINT) AS priced, array_to_string(list_filter([CASE WHEN n = 0 THEN 'no_rows' END, CASE WHEN active < 0.9 * n THEN 'low_coverage' END, CASE WHEN priced = 0 THEN 'nothing_priced' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT n_nationkey, count(c_custkey) AS n, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS active, count(*) FILTER (WHERE c_acctbal > 0) AS priced FROM (SELECT n_nationkey FROM nation UNION ALL SELECT -1) LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)""")
def source_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Gates on whole sources: rows, coverage of a field, anything priced."""
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation").select("n_nationkey").unionByName(spark.range(1).select((F.col("id") - 1).alias("n_nationkey")))  # and a source without rows
    g = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"), F.count_if(F.col("c_mktsegment") != "BUILDING").alias("active"), F.count_if(F.col("c_acctbal") > 0).alias("priced"))
    rules = [("no_rows", F.col("n") == 0), ("low_coverage", F.col("active") < 0.9 * F.col("n")), ("nothing_priced", F.col("priced") == 0)]
    return g.withColumn("reasons", F.array_join(gates.all_failing(rules), ","))


@query("""SELECT sha256(text) AS text_sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY text""")
def best_row_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """One row a text: the first by doc_id."""
    d = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "source")
    return d.groupBy("text_sha256").agg(F.min(F.struct("doc_id", "source")).alias("f"), F.count("*").alias("copies")).select("text_sha256", "f.doc_id", "f.source", "copies")


@query("""SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def last_wins_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return best_row(table(spark, folder, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@query("""SELECT doc_id, kept FROM (SELECT doc_id, first_value(doc_id) OVER w AS kept, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY text ORDER BY n_chars DESC, doc_id)) WHERE n > 1""")
def dedupe_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that lost to an equal one, and to which."""
    d = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "n_chars")
    return losers(d, ["key"], F.struct(-F.col("n_chars"), F.col("doc_id")), "doc_id").select("doc_id", "kept")


@query("""SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS priority, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice > 250000) AS price FROM orders GROUP BY o_custkey""")
def best_value_per_field(spark: SparkSession, folder: str) -> DataFrame:
    """Each field from its own best row: the freshest that has it."""
    o = table(spark, folder, "orders")
    fresh = F.struct("o_orderkey")
    return o.groupBy("o_custkey").agg(
        F.max_by("o_orderpriority", F.when(F.col("o_orderstatus") == "F", fresh)).alias("priority"), F.max_by("o_totalprice", F.when(F.col("o_totalprice") > 250000, fresh)).alias("price")
    )


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE round_even(CAST(o_orderkey % 61 AS DECIMAL(18,6)) / 10, 2) END AS score, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 1000 END AS n FROM orders)
SELECT o_custkey, CAST(arg_max(score, (o_orderdate, o_orderkey)) AS DOUBLE) AS score, arg_max(n, (o_orderdate, o_orderkey)) AS count FROM t WHERE score BETWEEN 0 AND 5 AND n >= 1 GROUP BY o_custkey""")
def rating_pair_atomic(spark: SparkSession, folder: str) -> DataFrame:
    """Score and count from one row, the freshest where both are valid."""
    o = table(spark, folder, "orders")
    score = F.when(F.col("o_orderkey") % 6 != 0, (F.col("o_orderkey") % 61).cast("decimal(18,6)") / 10)
    n = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 1000)
    rated = o.select("o_custkey", "o_orderdate", "o_orderkey", rating_pair(score, n).alias("r")).where("r IS NOT NULL")
    return best_of(rated, ["o_custkey"], F.col("r"), F.struct("o_orderdate", "o_orderkey"), "r").select("o_custkey", "r.*")


@query("""WITH t AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS BIGINT) AS grams, l_extendedprice AS price, (CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) + (CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) + 1 AS filled FROM lineitem)
SELECT l_partkey, grams, l_orderkey, price FROM t QUALIFY row_number() OVER (PARTITION BY l_partkey, grams ORDER BY filled DESC, price, l_orderkey, l_linenumber, l_suppkey) = 1""")
def best_per_weight(spark: SparkSession, folder: str) -> DataFrame:
    """One variant a product and weight: the most complete, then the cheapest."""
    i = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long").alias("grams"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"), "l_returnflag")
    best = best_row(i, ["l_partkey", "grams"], [filled("discount", "tax", "l_returnflag").desc(), F.asc("price"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey")])
    return best.select("l_partkey", "grams", "l_orderkey", "price")


@query("""SELECT p_brand, arg_min(p_name, (length(p_name), p_name)) AS name, count(*) AS products, max(p_size) AS largest FROM part GROUP BY p_brand""")
def shortest_name(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.length("p_name"), F.col("p_name"))).alias("name"), F.count("*").alias("products"), F.max("p_size").alias("largest"))


@query("""SELECT c_custkey, CAST(round_even((CASE WHEN c_name <> '' THEN 1 ELSE 0 END + CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) * 35.0 / 3 + (CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END) * 45.0 / 2 + CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 0 END, 0) AS INTEGER) AS score FROM customer""")
def completeness(spark: SparkSession, folder: str) -> DataFrame:
    common = [F.col("c_name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))]
    special = [F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")), F.lit(None).cast("string")]
    return table(spark, folder, "customer").select("c_custkey", gates.completeness(common, special, F.col("c_custkey") % 3 == 0).alias("score"))


@query("""SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,3)) / 8, 2) AS DOUBLE) AS up, CAST(round_even(CAST(p_retailprice AS DECIMAL(18,3)) * CAST(0.125 AS DECIMAL(4,3)), 2) AS DOUBLE) AS even FROM part""".replace("round(CAST(p_retailprice AS DECIMAL(18,3)) / 8, 2)", "round(CAST(p_retailprice AS DECIMAL(18,3)) * CAST(0.125 AS DECIMAL(4,3)), 2)"))
def rounding_modes(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("p_retailprice").cast("decimal(18,3)") * F.lit("0.125").cast("decimal(4,3)")
    return table(spark, folder, "part").select("p_partkey", half_up(x, 2).alias("up"), half_even(x, 2).alias("even"))


@query("""SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AS closed, (CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END) IS NOT NULL AND c_acctbal >= 100 AS half_open, true AS open FROM customer""")
def range_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Null passes a range only where both bounds are open."""
    gap = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))
    return table(spark, folder, "customer").select("c_custkey", within(F.col("c_acctbal"), 0, 5000).alias("closed"), within(gap, 100, None).alias("half_open"), within(gap, None, None).alias("open"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), p AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM d)
SELECT day, n, before, CASE WHEN before > 0 THEN greatest(0.0, CAST(before - n AS DOUBLE) / before) ELSE 0.0 END AS share, coalesce(CASE WHEN before > 0 THEN greatest(0.0, CAST(before - n AS DOUBLE) / before) ELSE 0.0 END <= 0.30 AND n >= 100, false) AS passed FROM p""")
def continuity_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Each day against the day before: passed if no more than 30 % is gone and the floor is kept."""
    from pyspark.sql import Window

    d = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    p = d.withColumn("before", F.lag("n").over(Window.orderBy("day")))  # a row a day
    share = drop_share(F.col("before").cast("double"), F.col("n").cast("double"))
    return p.select("day", "n", "before", share.alias("share"), ((share <= 0.30) & (F.col("n") >= 100)).alias("passed"))
