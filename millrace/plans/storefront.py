"""What a shop window shows, and feeds of shops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import feeds, storefront
from millrace.plans.registry import query
from millrace.sources.tables import table

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity % 4 = 0 THEN '$' || CAST(l_quantity AS BIGINT) ELSE printf('$%.2f', l_quantity + 0.25) END AS money, printf('$%.2f/g', l_quantity / 4) AS per, CASE WHEN l_quantity % 2 = 0 THEN CAST(l_quantity / 2 AS BIGINT) || 'g' ELSE printf('%.1fg', l_quantity / 2) END AS weight,
 CASE WHEN l_quantity * 2.5 <= 100 THEN CAST(floor(l_quantity * 2.5 + 0.5) AS BIGINT) || '%' ELSE '—' END AS share, CASE WHEN l_linenumber < 6 AND l_suppkey > 0 THEN printf('%.1f', l_linenumber * 1.0) || ' (' || l_suppkey || ')' END AS rating,
 CASE WHEN l_linenumber <> 1 THEN CAST(floor((l_linenumber - 1) * 100.0 / l_linenumber + 0.5) AS INTEGER) END AS discount FROM lineitem""")
def displayed(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers as a shop window writes them."""
    q, n, s = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey")
    return table(spark, folder, "lineitem").select(
        *_KEYS, storefront.money(F.when(q % 4 == 0, q).otherwise(q + 0.25)).alias("money"), storefront.unit_price(q / 4).alias("per"), storefront.weight(q / 2).alias("weight"), storefront.percent(q * 2.5).alias("share"),
        storefront.rating(n.cast("double"), s).alias("rating"), storefront.discount(n.cast("double"), F.lit(1.0)).alias("discount"),
    )


@query("""WITH v AS (SELECT l_partkey AS product_id, 'v' || (l_orderkey % 30) AS variant_id, l_quantity AS grams, l_extendedprice AS price, l_extendedprice / l_quantity AS unit_price, (l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS place FROM lineitem WHERE l_suppkey % 6 <> 2),
 f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY product_id, variant_id ORDER BY place) = 1)
SELECT product_id, variant_id, grams, price FROM f QUALIFY row_number() OVER (PARTITION BY product_id, grams ORDER BY unit_price, price, variant_id) = 1""")
def shown_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The variants a product shows: first of an id, best of a weight."""
    v = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("product_id"), F.concat(F.lit("v"), F.col("l_orderkey") % 30).alias("variant_id"), F.col("l_quantity").alias("grams"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("place"), "l_suppkey")
    return storefront.sizes(v, F.col("l_suppkey") % 6 != 2, "place").select("product_id", "variant_id", "grams", "price")


@query("""SELECT CAST(l_partkey AS VARCHAR) AS product_id, CASE WHEN l_suppkey % 7 = 0 THEN l_partkey || ':' || l_orderkey ELSE 'v' || l_orderkey END AS variant_id, CASE WHEN l_linenumber = 2 THEN l_quantity + 1 ELSE l_quantity END AS weight, l_extendedprice AS price,
 CASE WHEN l_linenumber % 2 = 0 THEN 9.5 ELSE l_extendedprice / l_quantity END::DOUBLE AS unit_price FROM lineitem WHERE l_suppkey % 9 <> 4""")
def compact_variants(spark: SparkSession, folder: str) -> DataFrame:
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    v = table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"), F.when(s % 7 == 0, "").otherwise(F.concat(F.lit("v"), "l_orderkey")).alias("variant_id"), F.when(n == 2, F.col("l_quantity") + 1).alias("weight"), F.col("l_quantity").alias("grams"),
        F.when(s % 9 != 4, F.col("l_extendedprice")).alias("price"), F.when(n % 2 == 0, 9.5).alias("price_per_gram"), F.col("l_orderkey").alias("place"),
    )
    return storefront.compact_variants(v)


@query(r"""SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_brand AS vendor_id, p_brand AS vendor, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'indica' WHEN 1 THEN 'hybrid' ELSE 'unknown' END AS lineage, trim(regexp_replace(lower(p_brand || chr(10) || p_name), '[\p{P}\p{S}\s]+', ' ', 'g')) AS search_text FROM part""")
def compact_products(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, folder, "part").select(F.when(k % 2 == 0, k).alias("id"), k.alias("product_id"), F.lit(None).cast("string").alias("vendor_id"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("name"), F.when(k % 3 == 0, "indica").when(k % 3 == 1, "hybrid").otherwise("?").alias("lineage"))
    return storefront.compact_products(p)


@query("""SELECT p_brand AS vendor_id, arg_min(p_name, p_partkey) AS name FROM part WHERE p_size % 5 <> 0 AND p_brand <> 'Brand#3' GROUP BY p_brand""")
def window_vendors(spark: SparkSession, folder: str) -> DataFrame:
    """The first name of each vendor that has something to show."""
    p = table(spark, folder, "part").select(F.when(F.col("p_brand") == "Brand#3", " ").otherwise(F.col("p_brand")).alias("vendor_id"), F.col("p_name").alias("vendor_name"), (F.col("p_size") % 5 != 0).alias("has_variants"), "p_partkey")
    return storefront.vendors(p, "p_partkey")


@query("""SELECT coalesce(t, 'none') AS type, count(*) AS rows FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'cannabis_vape' WHEN 1 THEN 'psilocybin_vape' WHEN 2 THEN NULL WHEN 3 THEN 'cannabis_flower' WHEN 4 THEN NULL ELSE 'psilocybin_mushroom' END AS t FROM part) GROUP BY 1""")
def inferred_types(spark: SparkSession, folder: str) -> DataFrame:
    """Stated types, those of the evidence, and flower by its signals, counted."""
    k = F.col("p_partkey") % 6
    stated, evident = F.when(k == 0, "cannabis_vape").when(k == 2, "other"), F.when(k == 1, "psilocybin_vape").when(k == 0, "cannabis_flower").when(k == 5, "psilocybin_mushroom")
    t = storefront.inferred_type(stated, evident, k.isin(3, 4, 5), k.isin(2, 3, 5))
    return table(spark, folder, "part").select(F.coalesce(t, F.lit("none")).alias("type")).groupBy("type").agg(F.count("*").alias("rows"))


@query("""WITH p AS (SELECT p_partkey, p_brand AS vendor, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS price, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS comparison_price, p_size % 7 AS completeness_score FROM part WHERE contains(lower(p_brand || chr(10) || p_name), 'in'))
SELECT * FROM (SELECT 'price_asc' AS sort, p_partkey, CAST(row_number() OVER (ORDER BY price NULLS LAST, p_partkey) AS INTEGER) AS place FROM p UNION ALL SELECT 'price_desc', p_partkey, CAST(row_number() OVER (ORDER BY price DESC NULLS LAST, p_partkey) AS INTEGER) FROM p UNION ALL SELECT 'metric_asc', p_partkey, CAST(row_number() OVER (ORDER BY comparison_price NULLS LAST, p_partkey) AS INTEGER) FROM p
 UNION ALL SELECT 'metric_desc', p_partkey, CAST(row_number() OVER (ORDER BY comparison_price DESC NULLS LAST, p_partkey) AS INTEGER) FROM p UNION ALL SELECT 'completeness_desc', p_partkey, CAST(row_number() OVER (ORDER BY completeness_score DESC NULLS LAST, p_partkey) AS INTEGER) FROM p UNION ALL SELECT 'name', p_partkey, CAST(row_number() OVER (ORDER BY name, p_partkey) AS INTEGER) FROM p) WHERE place <= 25""")
def typed_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The first 25 rows of a typed list in its six orders (a top-k report): nulls last in both directions."""
    k = F.col("p_partkey")
    p = table(spark, folder, "part").select(k, F.col("p_brand").alias("vendor"), F.col("p_name").alias("name"), F.lit("").alias("species"), F.when(k % 4 != 0, F.col("p_size")).alias("price"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("comparison_price"), (F.col("p_size") % 7).alias("completeness_score"))
    rows, out = storefront.typed_filter(p, text=" IN "), None
    for sort in (*storefront.TYPED_SORTS, "name"):
        order = storefront.typed_order(sort, "name", "p_partkey")
        part = rows.orderBy(*order).limit(25).select(F.lit(sort).alias("sort"), "p_partkey", F.row_number().over(Window.orderBy(*order)).alias("place"))  # over 25 rows
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH f AS (SELECT 'Brand & ' || (s_suppkey % 40) AS n, s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'verification' WHEN 1 THEN 'verification' WHEN 2 THEN 'confirmation' WHEN 3 THEN 'no_gate_observed' ELSE 'unknown' END AS badge FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 40 ORDER BY s_suppkey DESC) = 1)
SELECT c_custkey, badge FROM customer LEFT JOIN f ON n = 'Brand & ' || (c_custkey % 60)""")
def vendor_badges(spark: SparkSession, folder: str) -> DataFrame:
    """Badges by normalised vendor name; the last profile of a name counts."""
    k = F.col("s_suppkey")
    f = table(spark, folder, "supplier").select(k, F.concat(F.lit("BRÄND and "), k % 40).alias("vendor_name"), F.when(k % 5 == 0, "verification").when(k % 5 == 4, "unknown").alias("display"), F.when(k % 5 == 1, "identity_verification_required").when(k % 5 == 2, "self_attestation_21_plus").when(k % 5 == 3, "no_observed_gate").alias("classification"))
    c = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("Brand & "), F.col("c_custkey") % 60).alias("vendor"))
    return storefront.badges(c, f, "s_suppkey").select("c_custkey", "badge")


@query("""SELECT o_custkey AS product_id, min(o_orderkey % 8 * 1000000 + o_orderkey) % 1000000 AS o_orderkey FROM orders GROUP BY o_custkey""")
def retained_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Of all pages held each product where it comes first."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("product_id"), (F.col("o_orderkey") % 8).alias("offset"), "o_orderkey")
    return storefront.retained(o, "offset", "o_orderkey").select("product_id", "o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'terpene' WHEN p_partkey % 3 = 1 THEN 'combined' END AS title FROM part""")
def selected_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The document of a kind, else a combined one."""
    k = F.col("p_partkey") % 3
    d = lambda kind, title: F.struct(F.lit(kind).alias("kind"), F.lit(title).alias("title"))
    docs = F.when(k == 0, F.array(d("combined_lab_report", "combined"), d("terpene_report", "terpene"), d("terpene_report", "later"))).when(k == 1, F.array(d("coa", "coa"), d("combined_lab_report", "combined"))).otherwise(F.array(d("coa", "coa")))
    return table(spark, folder, "part").select("p_partkey", storefront.document_of(docs, "terpene_report")["title"].alias("title"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN d.p_size > 25 THEN d.p_name END AS detail FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) d ON p_partkey = l_partkey""")
def index_with_details(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "lineitem").select(*_KEYS, F.col("l_partkey").alias("variant_id"))
    d = table(spark, folder, "part").where("p_size > 25").select(F.col("p_partkey").alias("variant_id"), F.col("p_name").alias("detail"))
    return storefront.with_details(i, d, ["detail"]).drop("variant_id")


_LABEL = "CASE l_orderkey % 6 WHEN 0 THEN '3.5 g' WHEN 1 THEN '1/4 oz' WHEN 2 THEN '' WHEN 3 THEN 'large' WHEN 4 THEN '28 grams' ELSE 'quarter' END"


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_LABEL} AS label, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'Item ' || l_partkey ELSE trim('Parent ' || (l_partkey % 50) || ' ' || label) END AS name, CASE WHEN l_linenumber <> 1 THEN label END AS label,
 CASE WHEN l_linenumber <> 1 THEN CASE l_orderkey % 6 WHEN 0 THEN 3.5 WHEN 1 THEN 7.0 WHEN 4 THEN 28.0 WHEN 5 THEN 7.0 END END::DOUBLE AS grams, CASE WHEN l_suppkey % 5 = 1 THEN q ELSE q * 2 END / CASE WHEN l_suppkey % 3 = 1 THEN 1000.0 ELSE 100.0 END AS price,
 CASE WHEN l_linenumber <> 1 AND l_suppkey % 4 = 3 THEN 'variation_not_explicitly_in_stock' WHEN l_linenumber <> 1 AND l_orderkey % 6 IN (2, 3) THEN 'variation_weight_missing' END AS reason FROM i""")
def store_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a shop's feed: simple ones, and variations of variable parents with label, weight, price and refusals."""
    n, s, q = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    child, label = n != 1, F.expr(_LABEL)
    none = F.lit(None).cast("string")
    i = table(spark, folder, "lineitem")
    own = i.select(
        F.to_json(F.struct(*_KEYS)).alias("id"), F.when(child & (n % 2 == 0), "Variation").alias("type"), F.when(child, F.col("l_partkey") % 50).alias("parent"), F.when(~child, F.concat(F.lit("Item "), "l_partkey")).otherwise(F.concat(F.lit("PARENT "), F.col("l_partkey") % 50, F.lit(" - "), label)).alias("name"), F.lit(False).alias("has_options"),
        F.when(s % 4 == 3, "outofstock").otherwise("instock").alias("stock"), F.when(n % 3 == 0, label).alias("variation"), F.when(n % 3 == 1, F.array(F.lit(" "), label)).alias("attributes"), F.when(s % 5 == 1, q.cast("string")).otherwise("0").alias("sale_price"), F.when(s % 5 != 2, (q * 2).cast("string")).alias("price"), (q * 2).cast("string").alias("regular_price"), F.when(s % 3 == 1, 3).when(s % 3 == 2, 0).alias("minor_unit"),
    )
    parents = spark.range(50).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("variable").alias("type"), F.lit(None).cast("long").alias("parent"), F.concat(F.lit("Parent "), "id").alias("name"), F.lit(True).alias("has_options"), none.alias("stock"), none.alias("variation"), F.lit(None).cast("array<string>").alias("attributes"), none.alias("sale_price"), none.alias("price"), none.alias("regular_price"), F.lit(None).cast("int").alias("minor_unit"))
    items = own.withColumn("parent", F.col("parent").cast("string")).unionByName(parents.withColumns({"parent": none, "id": F.regexp_replace("id", "^p", "")}))
    rows = feeds.store_rows(items)
    keys = F.from_json("id", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    return rows.select(keys.alias("k"), F.trim("name").alias("name"), "label", "grams", "price", "reason").select("k.*", "name", "label", "grams", "price", "reason")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 3.5 WHEN 1 THEN 448.0 WHEN 2 THEN 28.0 WHEN 3 THEN 13.0 ELSE 7.0 END::DOUBLE AS grams, CASE o_orderkey % 5 WHEN 0 THEN '3.5g' WHEN 1 THEN '1 lb' WHEN 2 THEN '1 oz' WHEN 3 THEN 'kept' ELSE 'quarter' END AS source_weight_label FROM orders WHERE o_custkey % 4 <> 1""")
def flower_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of flower or of no type, their weights from the first label that agrees, pounds once read as ounces repaired."""
    k = F.col("o_orderkey") % 5
    o = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 4 == 1, "cannabis_vape").when(F.col("o_custkey") % 4 == 2, " Cannabis_Flower ").alias("primary_type"), F.lit(None).cast("string").alias("evidence_type"),
        F.when(k == 0, 3.5).when(k == 1, 28.0).when(k == 2, 28.35).when(k == 3, 13.0).alias("grams"), F.when(k == 3, "kept").otherwise("").alias("source_weight_label"), F.when(k == 0, "1 oz").when(k == 3, "2 lb").otherwise("bag").alias("variant"), F.when(k == 0, "tin 3.5g").when(k == 1, "Sack 1 lb").when(k == 2, "1 oz").when(k == 4, "a quarter").otherwise("x").alias("name"),
    )
    return feeds.flower_rows(o).select("o_orderkey", "grams", "source_weight_label")


@query("""SELECT o_custkey, arg_max(v, (r, v IS NOT NULL, o_orderdate, o_orderkey)) AS value, arg_max(m, (r, v IS NOT NULL, o_orderdate, o_orderkey)) AS method FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'direct_source_total_thc' WHEN 1 THEN 'delta9_plus_thca_times_0_877' WHEN 2 THEN 'thca_only_estimate' ELSE 'other' END AS m,
 CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS r, coalesce(o_orderkey % 30, -1) AS v FROM orders) GROUP BY o_custkey""")
def best_potencies(spark: SparkSession, folder: str) -> DataFrame:
    """The potency of the best method, then the latest."""
    k = F.col("o_orderkey")
    o = table(spark, folder, "orders").select("o_custkey", F.when(k % 4 == 0, "direct_source_total_thc").when(k % 4 == 1, "delta9_plus_thca_times_0_877").when(k % 4 == 2, "thca_only_estimate").otherwise("other").alias("method"), (k % 30).alias("value"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("collected_at"), k.alias("record_id"))
    return feeds.best_potency(o, "o_custkey")


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, list(event_type ORDER BY event_type) FILTER (WHERE event_type <> 'view') AS names, sum(least(n, 100000)) FILTER (WHERE event_type <> 'view') AS total FROM t GROUP BY user_id)
SELECT user_id, 'u' || user_id AS route, array_to_string(names, ',') AS reasons, CAST(total AS BIGINT) AS failures, CASE WHEN user_id % 3 = 0 THEN repeat('x', 300) END AS error FROM m WHERE names IS NOT NULL""")
def public_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of routes within their bounds: well-formed reasons in order, capped counts, a short error."""
    n = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    name = F.when(F.col("event_type") == "view", "Not A Reason").otherwise(F.col("event_type"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(name.alias("k"), "n"))).alias("reasons")).withColumns({"route": F.concat(F.lit("u"), "user_id"), "failures": F.lit(0).cast("long"), "records": F.array().cast("array<string>"), "error": F.when(F.col("user_id") % 3 == 0, F.repeat(F.lit("x"), 500))})
    return feeds.public_route(m, ["user_id", "route"]).where(F.size("reasons") > 0).select("user_id", "route", F.array_join(F.map_keys("reasons"), ",").alias("reasons"), "failures", "error")


@query("""SELECT user_id, event_type AS name, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS n FROM events GROUP BY ALL""".replace("sum(CAST(json_extract(props, '$.k') AS BIGINT))", "CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT)"))
def diagnostic_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of maps of counters."""
    e = table(spark, folder, "events").select("user_id", F.lit(1).alias("requests"), F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")).alias("reasons"))
    return feeds.summed_counts(e, ["user_id"], ["requests"], ["reasons"])[1]["reasons"]


@query("""WITH r AS (SELECT c_nationkey AS source, 'https://x/' || (c_custkey % 30) AS u, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS new, c_custkey FROM customer WHERE c_custkey % 7 <> 3)
SELECT source, u, c_custkey FROM r QUALIFY row_number() OVER (PARTITION BY source, u ORDER BY new, c_custkey) = 1""")
def merged_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Known routes before new ones, each address once."""
    k = F.col("c_custkey")
    c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("source"), F.lit("html").alias("type"), F.when(k % 7 == 3, "ftp://x").otherwise(F.concat(F.lit("https://x/"), k % 30, F.when(k % 3 == 0, "/").otherwise(""))).alias("url"), "c_custkey")
    rows = feeds.merged_routes(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), ["source"], "c_custkey")
    return rows.select("source", F.regexp_replace("url", "/+$", "").alias("u"), "c_custkey")


@query("""SELECT user_id, event_type, count(*) AS rows FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value > 180) GROUP BY ALL""")
def complete_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of routes without a failure; one failure discards its whole route."""
    e = table(spark, folder, "events").select("user_id", "event_type", "value", F.concat_ws("|", "user_id", "event_type").alias("route"))
    return feeds.all_or_nothing(e, "route", F.col("value") > 180).groupBy("user_id", "event_type").agg(F.count("*").alias("rows"))
