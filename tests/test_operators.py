"""Operators on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.extract import label_grams
from millrace.operators import gates, matching, offers, ranking, reports, segments
from millrace.sources import generator, pages, shards, snapshots
from millrace.streaming import health


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_first_failing_reason(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, price int")
    good, bad = gates.split(df, [("missing", F.col("price").isNull()), ("cheap", F.col("price") < 10)])
    assert rows(good) == [(3, 50)]
    assert rows(bad) == [(1, None, "missing"), (2, 5, "cheap")]


def test_price_and_potency_anchors(spark):
    df = spark.createDataFrame([(35.0, 40.0, 3.5), (35.0, 30.0, 3.5), (35.0, 35.0, 3.5), (0.0, None, 1.0)], "p double, o double, g double")
    got = gates.price_fields(df, F.col("p"), F.col("o"), F.col("g")).select("price", "original", "discount_percent", "per_gram", "warning").collect()
    assert [tuple(r) for r in got] == [(35.0, 40.0, 12.5, 10.0, None), (35.0, None, None, 10.0, "original_below_price"), (35.0, None, None, 10.0, None), (None, None, None, None, None)]
    df = spark.createDataFrame([(None, 0.0, 25.0), (None, None, 28.4), (30.0, 1.0, 1.0), (None, None, 200.0), (None, None, None)], "d double, b double, a double")
    got = gates.potency(df, F.col("d"), F.col("b"), F.col("a")).select("value", "display", "method").collect()
    assert [tuple(r) for r in got] == [(21.925, 22, "calculated"), (24.9068, 25, "estimate"), (30.0, 30, "direct"), (None, None, "rejected"), (None, None, "unavailable")]


def test_choice_comes_before_the_price_range(spark):
    v = spark.createDataFrame([(1, "a", 1.0, 40.0, 40.0), (1, "b", 28.0, 265.0, 9.46), (2, "c", 1.0, 45.0, 45.0)], "product_id int, variant_id string, grams double, price double, unit_price double")
    assert [r.product_id for r in offers.choose(v, offers.Request(price=(None, 50))).collect()] == [2]
    assert offers.choose(v, offers.Request(price=(60, 50))).count() == 0


def test_choice_ties(spark):
    v = spark.createDataFrame([(1, "z", 2.0, 10.0, 5.0), (1, "b", 1.0, 5.0, 5.0), (1, "a", 1.0, 5.0, 5.0), (1, "n", None, None, None)], "product_id int, variant_id string, grams double, price double, unit_price double")
    assert offers.choose(v, offers.Request()).first().variant_id == "a"


def test_request_is_normalised():
    r = offers.Request(sort="?", offset=-3, limit=9000, categories=("a", "b"), known_categories=("a",)).normalised()
    assert (r.sort, r.offset, r.limit, r.categories) == ("lowest_unit_price", 0, 500, ("a",))
    assert offers.Request(vendors=("b", "a")).identity() == offers.Request(vendors=("a", "b"), offset=120).identity()
    assert offers.next_offset(130, offers.Request()) == 120
    assert offers.next_offset(120, offers.Request()) is None


def test_best_row_and_audit_are_deterministic(spark):
    df = spark.createDataFrame([(1, "x", 3), (2, "x", 3), (3, "y", 1)], "id int, k string, v int")
    ranks = [F.desc("v"), F.asc("id")]
    assert rows(ranking.best_row(df, ["k"], ranks)) == [(1, "x", 3), (3, "y", 1)]
    assert rows(ranking.audit(df, ["k"], ranks, "id")) == [(2, "x", 3, 1)]


def test_decide_marks_ties(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "b", 9), (2, "a", 9), (2, "b", 5)], "k int, c string, score int")
    assert rows(matching.decide(df, ["k"], "c")) == [(1, None, 9, 2, "ambiguous"), (2, "a", 9, 1, "matched")]


def test_carry_forward(spark):
    now, old, ok = (spark.createDataFrame(x, "s string, v int") for x in ([("a", 1)], [("a", 0), ("b", 2), ("c", 3)], [("c", 0)]))
    assert rows(matching.carry_forward(now, old, "s", ok)) == [("a", 1, False), ("b", 2, True)]


def test_by_any_key_counts_a_pair_once(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, None, "q"), (3, "", None)], "i int, k1 string, k2 string")
    b = spark.createDataFrame([(10, "x", "p"), (11, "y", "q"), (12, "", "")], "d int, j1 string, j2 string")
    assert rows(matching.by_any_key(a, b, ["k1", "k2"], ["j1", "j2"], "d").select("i", "d")) == [(1, 10), (2, 11)]


def test_floor_percentile(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(7)], "k string, v double")
    assert rows(reports.floor_percentile(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0})) == [("a", 3.0, 6.0, 6.0)]


def test_segments_match_a_loop(spark):
    sizes = [(i % 3, i, (i * 37) % 50 + 1) for i in range(200)]
    got = {(r.b, r.i): r.segment for r in segments.fit_segments(spark.createDataFrame(sizes, "b int, i int, n int"), "b", ["i"], "n", 100).collect()}
    for b in range(3):
        segment = used = 0
        for _, i, n in (x for x in sizes if x[0] == b):
            if used + n > 100:
                segment, used = segment + 1, 0
            used += n
            assert got[b, i] == segment


def test_shards(spark, tmp_path):
    product = {"id": "1", "source_id": "s", "vendor": "v", "name": "n", "price": "5"}
    for i in (1, 2):
        (tmp_path / f"shard-{i}.json").write_text(json.dumps({"schema_version": "3", "shard": i, "products": [product, product | {"source_id": "t"}], "sources": [{"source_id": "s", "name": "S", "admitted": True, "status": "ok"}]}))
    found = shards.read_shards(spark, str(tmp_path), "3")
    offers_ = shards.offers(found)
    assert offers_.count() == 4
    assert shards.admitted(offers_, found).count() == 2
    with pytest.raises(ValueError, match="schema version"):
        shards.read_shards(spark, str(tmp_path), "4")


def test_flatten(spark):
    df = spark.createDataFrame([(1, "p", [("x", None), ("y", "q")]), (2, "r", None)], "id int, name string, kids array<struct<kid:string,name:string>>")
    assert rows(shards.flatten(df, "kids")) == [(1, "p", "x"), (1, "q", "y"), (2, "r", None)]


def test_structured_products(spark):
    block = json.dumps({"@graph": [{"@type": ["Product"], "name": "A", "offers": {"offers": [{"price": 5, "availability": "https://schema.org/InStock"}, {"lowPrice": "7", "url": "/u"}]}}]})
    page = f"<script type='application/ld+json'>{block}</script><script type='application/ld+json'>{{broken</script>"
    got = pages.structured_products(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id", "html")
    assert rows(got) == [(1, 0, "A", "5", "InStock", "", ""), (1, 1, "A", "7", "", "/u", "")]
    sized = json.dumps({"@type": "Product", "name": "B", "offers": [{"price": 5, "name": "3.5 g"}, {"price": 4, "name": "1/8 oz"}, {"price": 9, "name": "7g"}, {"name": "7g"}]})
    got = pages.structured_products(spark.createDataFrame([(1, f'<script type="application/ld+json">{sized}</script>')], "id int, html string"), "id", "html")
    assert rows(pages.per_weight(got, "id", label_grams("size")["grams"]).select("grams", "price", "size")) == [(3.5, "4", "1/8 oz"), (7.0, "9", "7g")]


def test_links_and_sitemap(spark):
    page = '<a href="/p/1?x">One</a> <A HREF="/p/1">again</A> <a href="https://y.example.com/p/2">Two</a> <a href="/about">About</a>'
    df = spark.createDataFrame([(1, "https://x.example.com/", page)], "id int, url string, html string")
    found = pages.links(df, "id", "url", "html")
    assert rows(pages.product_links(found, df, "id", "url", "/p/", 5).select("target", "label")) == [("https://x.example.com/p/1", "One")]
    xml = spark.createDataFrame([(1, "<urlset><loc> https://x.example.com/a </loc><loc>https://x.example.com/a/</loc></urlset>")], "id int, xml string")
    assert rows(pages.sitemap_urls(xml, "id", "xml").select("target")) == [("https://x.example.com/a",)]


def test_snapshot(spark, tmp_path):
    df = generator.offers(spark, 20)
    root = str(tmp_path / "s")
    first = snapshots.write(df, root, "product_id", 4)
    assert first == snapshots.content_id(df.orderBy(F.desc("variant_id")))
    assert snapshots.read(spark, root).count() == 80
    assert snapshots.lookup(spark, root, "product_id", "p-000003", 4).count() == 4
    second = snapshots.write(df.where("v_ok").drop("v_ok") if "v_ok" in df.columns else df.where("grams > 1"), root, "product_id", 4)
    assert second != first
    assert snapshots.read(spark, root).count() == 60
    assert snapshots.history(spark, root) == [first, second]
    assert snapshots.read(spark, root, back=1).count() == 80
    assert {r.shard for r in snapshots.manifest(snapshots.read(spark, root), "product_id").collect()} <= set(range(4))


def test_health_batch_and_stream_agree(spark, tmp_path):
    events = [(i, i % 3, f"2024-01-01 00:{i:02d}:00", (i * 7) % 5 < 2, i % 11 == 0, i % 17 == 3, i % 13 == 5, i == 40) for i in range(60)]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts string, failed boolean, signal boolean, hard boolean, blocked boolean, retired boolean").withColumn("ts", F.to_timestamp("ts"))
    states = health.next_state(df, ["user_id"], [F.col("ts"), F.col("event_id")], *(F.col(c) for c in ("failed", "signal", "hard", "blocked", "retired")))
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = states.withColumn("from_state", F.coalesce(F.lag("state").over(w), F.lit("probing"))).where("from_state <> state")
    want = rows(steps.select("user_id", "event_id", "from_state", "state"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = health.stream_changes(stream, "user_id").writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("changes")) == want


@pytest.mark.parametrize(
    ("row", "state"),
    [((True, True, True, 5, True), "retired"), ((False, True, True, 5, True), "blocked"), ((False, False, True, 0, False), "quarantined"), ((False, False, False, 2, False), "quarantined"), ((False, False, False, 1, False), "healthy"), ((False, False, False, 1, True), "degraded"), ((False, False, False, 0, False), "healthy")],
)
def test_next_state_rule(spark, row, state):
    assert spark.range(1).select(health.decided(*map(F.lit, row)).alias("s")).first().s == state


def test_generator_is_deterministic(spark):
    assert rows(generator.offers(spark, 5)) == rows(generator.offers(spark, 5).repartition(3))
