"""Character references, positions, names, sitemaps, sinks, publications and ordered streams against plain versions."""

from __future__ import annotations

import html
import html.entities
import json
import os
import random
import re
from urllib.parse import unquote, urlsplit

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import canonical, extract, positions
from millrace.functions.addresses import joined
from millrace.functions.entities import unescape
from millrace.functions.text import search_text
from millrace.operators import verification
from millrace.plans import structure
from millrace.sources import labs, publication, recovery, sitemaps
from millrace.sources.tables import spread
from millrace.streaming import health
from millrace.streaming.sinks import ConflictError, LedgerSink

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def by(rows, key, value):
    return {r[key]: r[value] for r in rows.collect()}


def test_references_decode_as_the_standard_says(spark):
    r = random.Random(3)
    bits = ["&", "&#", "&#36;", "&#x24", "&nbsp;", "&nbsp", "&eacute;", "&notit;", "&notin;", "&amp;amp;", "&AMP", "&#0;", "&#128;", "&#x80;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFFFFF;", "&#x0000000041;", "&#x1F600;"]
    bits += ["&#1;", "&#xfdd0;", "&#65535;", "&NotEqualTilde;", "&bogus;", "&copyright;", " ", "a", "é", "<", ";", "#", "&#13;", "&#x0b;", "&lt", "\n", "&ampx", *("&" + n for n in r.sample(sorted(html.entities.html5), 150))]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 8))) for _ in range(1500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(F.col("t")).alias("u")).collect()
    assert [x.u for x in got] == [html.unescape(x.t) for x in got]


def test_prices_and_ratings_behind_entities(spark):
    pages = [(1, '<bdi class="amount"><span>&#36;</span>35.00</bdi>'), (2, '<span class="price">$&nbsp;12.50</span>'), (3, "rated 4.5 stars, 12&nbsp;reviews"), (4, '<i data-rating="" data-average-rating="4" data-review-count="7">')]
    df = spark.createDataFrame(pages, "id int, html string")
    assert by(df.select("id", recovery.shown_price("html").alias("p")), "id", "p")[1] == 35.0
    assert by(recovery.product_price(df, "html"), "id", "price")[2] == 12.5
    assert by(recovery.product_price(spark.createDataFrame([(1, "x" * 1_600_000 + pages[1][1])], "id int, html string"), "html"), "id", "price")[1] == 12.5
    found = by(recovery.ratings(df, "html"), "id", "rating")
    assert tuple(found[3]) == (4.5, 12)
    assert tuple(found[4]) == (4.0, 7)
    assert found[1] is None


def test_links_keep_no_entities(spark):
    one = spark.range(1).select(joined(F.lit("https://x.example.com/"), F.lit("/caf&eacute;&#x2F;b")).alias("a")).first().a
    assert one == "https://x.example.com/café/b"


def test_search_has_one_folding(spark):
    rows = spark.createDataFrame([("ｏｎｅ ﬁve ①",), ("Ａ－Ｂ",), ("Été ŒUVRE",)], "t string")
    assert [r.k for r in rows.select(search_text("t").alias("k")).collect()] == ["one five 1", "a b", "ete œuvre"]


def test_weights_out_of_bounds_are_none(spark):
    cases = [(0.0, "label"), (0.04, "label"), (6000.0, "label"), (3.5, "agreed"), (7.0, "conflict")]
    rows = spark.createDataFrame([(x, "3.5 g") for x, _ in cases], "n double, label string").select(extract.weight(F.col("n"), "label")["method"].alias("m"))
    assert [r.m for r in rows.collect()] == [m for _, m in cases]


def test_labels_count_by_whole_words(spark):
    names = {"Beta Caryophyllene": "beta-caryophyllene", "Alpha Pinene": "alpha-pinene", "beta_pinene": "beta-pinene", "Pinenes": None, "total  Terpenes": "total", "THCA": "thca"}
    payload = json.dumps([{"name": n, "percent": i} for i, n in enumerate(names)])
    deep = '{"a": [' * 300 + '{"label": "Limonene", "percent": 3}' + "]}" * 300
    found = labs.structured(spark.createDataFrame([(1, payload), (2, deep), (3, "[" * 50_000), (4, None)], "id int, p string"), "id", "p").collect()
    assert sorted(r.field for r in found if r.id == 1) == sorted(["terpenes.beta-caryophyllene", "terpenes.alpha-pinene", "terpenes.beta-pinene", "total_terpenes", "cannabinoids.thca"])
    assert [(r.field, r.value, r.location) for r in found if r.id == 2] == [("terpenes.limonene", 3.0, "json_path:$" + ".a[0]" * 300 + ".percent")]
    assert [r.place for r in found if r.id in (3, 4)] == [-1, -1]


def test_walk_keeps_order_and_paths():
    value = {"b": [3, [{"label": "CBD", "value": 1, "units": " PCT "}], {"name": "é", "percent": 0}], "a b": {"name": "x", "result": {"name": "y", "percentage": False, "percent": 2}}, "": {"7": {"analyte": 5, "result": "<1"}}}
    got = [tuple(f[n] for n in ("location", "label", "result", "unit")) for f in labs._walk(value)]
    assert got == [('$[""]["7"].result', "5", "<1", ""), ("$.b[1][0].value", "CBD", "1", "pct"), ("$.b[2].percent", "é", "0", "%")]
    assert labs._walk(None) == labs._walk(5) == []


def test_a_label_is_looked_up_once(spark):
    rows = spark.createDataFrame([(1, "{}")], "id int, p string")
    plan = labs.first_values(labs.structured(rows, "id", "p"), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("THEN total_cannabinoids") == 1


def test_header_fields_of_json_make_no_paths(spark):
    value = {"b": [1, {"x": 2.5, "a": [["no", {"Batch": "B-7"}]]}, "no"], "Laboratory": "Lab 1", "off": True, "nothing": None, "é": {}}
    assert labs._said(value) == "Laboratory: Lab 1\nBatch: B-7\nx: 2.5" and labs._said(None) == "" and labs._said(5) == ": 5"
    deep = '{"a": [' * 300 + '{"Report date": "2024-05-06", "label": "THCA", "percent": 3}' + "]}" * 300
    assert labs._said(json.loads(deep)) == "Report date: 2024-05-06\nlabel: THCA\npercent: 3"
    found = labs.structured_fields(spark.createDataFrame([(1, json.dumps(value)), (2, deep), (3, "{"), (4, None)], "id int, p string"), "id", "p").collect()
    assert sorted((r.id, r.laboratory, r.report_date, r.batch_id) for r in found) == [(1, ": Lab 1", "", "B-7"), (2, "", ": 2024-05-06", ""), (3, "", "", ""), (4, "", "", "")]


def test_short_rows_are_dealt_to_many_tasks(spark, tmp_path):
    spark.range(12_000).coalesce(1).write.parquet(str(tmp_path / "t"))  # one small file
    rows = spread(spark.read.parquet(str(tmp_path / "t")), "id", 1_000)
    held = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in held) == 12_000 and len(held) == 12 and max(r.n for r in held) < 2_000
    assert spread(spark.range(0).toDF("id"), "id").collect() == []


def test_documents_lie_at_any_depth(spark):
    deep = '{"lab_reports": {"x": ' + '{"n": [' * 200 + '{"coa_url": "/a.pdf", "weird key": {"pdf": "/b.pdf"}}' + "]}" * 200 + "}}"
    found = recovery.json_documents(spark.createDataFrame([(1, "https://s.example.com/", deep)], "id int, u string, p string"), "id", "u", "p").collect()
    assert sorted(r.target for r in found) == ["https://s.example.com/a.pdf", "https://s.example.com/b.pdf"]
    assert any(r.path.endswith('["weird key"].pdf') for r in found)


def test_spots_and_places(spark):
    texts = ["abcabca", "", None, "xxabc", r"a\Eb a\Eb", "aXAx"]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(texts, ["abc", "x", "x", "", r"\E", "ax"], strict=True))], "i int, t string, n string")
    got = df.select("i", positions.spots(F.col("t"), "a[bX]").alias("s"), positions.places(F.lower("t"), F.col("n")).alias("p")).collect()
    assert {r.i: None if r.s is None else [tuple(x) for x in r.s] for r in got} == {0: [(0, 2), (3, 5)], 1: [], 2: None, 3: [(2, 4)], 4: [], 5: [(0, 2)]}
    assert {r.i: [x.start for x in r.p or []] for r in got if r.i != 4} == {0: [0, 3], 1: [], 2: [], 3: [], 5: [0, 2]}


def plain_name(title, variant):
    t, v = re.sub(r"\s+", " ", title).strip(), re.sub(r"\s+", " ", variant or "").strip()
    if v and t.lower().endswith(v.lower()):
        t = re.sub(rf"\s*(?:[|\-–—_:]+\s*)?{re.escape(v)}\s*$", "", t, flags=re.I).strip()
    before, whole = None, t
    while t and t != before:
        before = t
        for p in extract.NAME_ENDINGS:
            t = re.sub(p, "", t, flags=re.I).strip(" |-_–—:") or t
    return t or whole


def test_names_to_a_fixpoint(spark):
    r = random.Random(4)
    bits = ["Blue Dream", "OG", "Flower", "THCA Flower", "- 3.5 g", "| indoor", "(Indoor)", "tier 2", "premium", "Exotic", " - Best Seller", "Hemp Flower", "— 1/8 oz", ": zip", "smalls", "_ whole flower", "High THC-A", "sale", "3.5 g", "x", "|", "-"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 6))), r.choice([None, "", "3.5 g", "Indoor", "1/8 oz", "zip"])) for i in range(400)]
    got = by(extract.canonical_names(spark.createDataFrame(rows, "i int, t string, v string"), "t", "v"), "i", "name")
    want = {i: plain_name(t, v) for i, t, v in rows}
    assert {i: n for i, n in got.items() if want[i]} == {i: n for i, n in want.items() if n}


def plain_effects(text):
    t = re.sub(r"\s+", " ", html.unescape(text).replace("\xa0", " ")).strip()
    context = " ".join(t[max(0, m.start() - 40) : m.start() + 420] for m in re.finditer(extract.EFFECT_CONTEXT.replace("(?iU)", "(?i)"), t))
    denied = re.compile(extract.EFFECT_DENIED.replace("(?iU)", "(?i)"))
    return [n for n, p in extract.EFFECTS if any(not denied.search(context[max(0, m.start() - 35) : m.start()]) for m in re.finditer(p, context, re.I))][:12]


@tables
def test_effects_of_whole_documents(spark):
    want = {r.doc_id: ", ".join(plain_effects(r.text)) for r in structure.spoken(spark, FOLDER).collect()}
    assert by(structure.document_effects(spark, FOLDER), "doc_id", "effects") == want
    assert len(set(want.values())) > 10


def test_effects_in_mixed_contexts(spark):
    r = random.Random(4)
    w = ["relaxing", "calm", "not", "no", "very", "without", "effects of", "experience", "happy", "focus", "couch-lock", "energy boost", "uplifting energy", "is", "delivers", "known for", "lorem ipsum dolor", "sleepy.", "creative", "social", "hunger", "pain relief", "mental clarity", "euphoria", "bedtime", "éa", "stress relief", "eases tension", "x" * 30]
    rows = [(i, " ".join(r.choice(w) for _ in range(r.randint(0, 120)))) for i in range(200)]
    got = by(extract.effects(spark.createDataFrame([*rows, (-1, None)], "i int, t string"), "t"), "i", "effects")
    assert got == {-1: []} | {i: plain_effects(t) for i, t in rows}


def plain_context(payload, target):
    source, at = (payload or "").replace("\\/", "/"), 0
    handle, places = unquote(urlsplit(target).path.rstrip("/").split("/")[-1]).lower(), []
    while handle and len(places) < 16 and (at := source.lower().find(handle, at)) >= 0:
        places.append(at)
        at += len(handle)
    return "\n".join(source[max(0, p - 6000) : p + 9000] for p in places) or source[:240_000]


@tables
def test_contexts_of_whole_pages(spark):
    import hashlib

    want = {r.page_id: hashlib.md5(plain_context(r.html, r.url).encode()).hexdigest() for r in structure.named_pages(spark, FOLDER).collect()}
    assert by(structure.target_contexts(spark, FOLDER), "page_id", "context_md5") == want


def test_contexts_of_odd_targets(spark):
    r = random.Random(6)
    bits = ["lorem ", "ipsum\\/", "BLUE-Dream", "a.b(c", "x\\ey", "café", " z+z ", "é" * 50, "q" * 3000]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60))), "https://s.example.com/p/" + r.choice(["blue-dream", "a.b(c", "X\\Ey", "Caf%C3%A9", "z+z", ""]) + r.choice(["", "/", "?v=1"])) for i in range(60)]
    got = by(recovery.target_context(spark.createDataFrame(rows, "i int, p string, t string"), "p", "t"), "i", "context")
    assert got == {i: plain_context(p, t) for i, p, t in rows}


def test_sitemaps_with_loops_and_gaps(spark):
    a = "https://a.example.com"
    files = [
        (f"{a}/sitemap.xml", f"<loc>/sitemap.xml</loc><loc>{a}/sitemap-lost.xml</loc><loc>/sitemap-1.xml</loc><loc>/products/1</loc><loc>/products/1</loc><loc>/blog/products/2</loc>"),
        (f"{a}/sitemap-1.xml", f"<loc>{a}/sitemap.xml</loc><loc>/products/3</loc><loc>https://b.example.com/products/9</loc>"), (f"{a}/sitemap-1.xml", None), ("https://c.example.com/s.xml", ""),
    ]
    roots = spark.createDataFrame([("a", f"{a}/sitemap.xml"), ("c", "https://c.example.com/s.xml"), ("d", "https://d.example.com/s.xml")], "source string, url string")
    products, read = sitemaps.sitemap_products(roots, spark.createDataFrame(files, "url string, xml string"), "url", "xml")
    assert sorted(map(tuple, products.collect())) == [("a", 1, f"{a}/products/1"), ("a", 2, f"{a}/products/3")]
    assert sorted((r.document, r.target) for r in read.collect() if r.source == "a") == [(1, f"{a}/sitemap.xml"), (2, f"{a}/sitemap-lost.xml"), (3, f"{a}/sitemap-1.xml")]


def test_sitemaps_out_of_reach_are_not_taken_apart(spark):
    a = "https://a.example.com"
    files = [(f"{a}/sitemap.xml", "<loc>/sitemap-1.xml</loc><loc>/products/1</loc>", "x"), (f"{a}/sitemap-1.xml", "<loc>/products/2</loc><loc>/products/1</loc>", "x"), (f"{a}/sitemap-2.xml", "<loc>/products/3</loc>", "y")]
    roots = spark.createDataFrame([("a", f"{a}/sitemap.xml")], "source string, url string")
    body = F.expr("CASE WHEN source = 'y' THEN raise_error('taken apart') ELSE text END")  # columns named as those of the roots
    products, read = sitemaps.sitemap_products(roots, spark.createDataFrame(files, "url string, text string, source string"), "url", body)
    assert sorted(map(tuple, products.collect())) == [("a", 1, f"{a}/products/1"), ("a", 2, f"{a}/products/2")]
    assert read.count() == 2


def test_a_cached_value_without_parts_is_a_value(spark, tmp_path):
    ids = [0, 97, 18127, 40805, 63483, 86161]  # the first two are no value, the others lack id, manifest and index
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    codes = by(structure.cached_generations(spark, str(tmp_path)), "event_id", "code")
    assert codes[0] == codes[97] == "cache_value_invalid"
    assert {codes[i] for i in ids[2:]} == {"cache_generation_id_missing"}
    rows = spark.range(4).selectExpr("id", "CASE id WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END AS there", "CASE WHEN id = 3 THEN 'x' END AS corruption_code", "CAST(NULL AS string) AS generation_id", "CAST(NULL AS struct<schema_ok:boolean,generation_id:string>) AS manifest",
        "CAST(NULL AS struct<generation_id:string,product_count:int,products:array<struct<product_id:string,variants:array<int>>>>) AS index", "CAST(NULL AS timestamp) AS cached_at", "CAST(NULL AS timestamp) AS generated_at")
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    assert by(verification.cached_generation(rows, now, there=F.col("there")), "id", "code") == {0: "cache_generation_id_missing", 1: "cache_value_invalid", 2: "cache_value_invalid", 3: "x"}
    assert by(verification.cached_generation(rows, now), "id", "code") == {0: "cache_value_invalid", 1: "cache_value_invalid", 2: "cache_value_invalid", 3: "x"}


SCHEMA = "id string, a long, b string"


def test_sink_gives_each_batch_once(spark, tmp_path):
    sink = LedgerSink(str(tmp_path / "sink"), "id", SCHEMA)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    have = lambda: sorted(tuple(r) for r in sink.read(spark).select("id", "a", "b").collect())
    first, second = [("x", 1, "p"), ("y", 2, None), ("x", 1, "p")], [("x", 1, "p"), ("z", 3, "q")]
    sink(frame(first), 0)
    assert have() == [("x", 1, "p"), ("y", 2, None)]
    sink(frame(first[::-1]), 0)  # a replay, in another order
    assert have() == [("x", 1, "p"), ("y", 2, None)]
    with pytest.raises(ConflictError, match="other rows"):
        sink(frame(second), 0)
    with pytest.raises(ConflictError, match="for key y"):
        sink(frame([("w", 1, "r"), ("y", 2, "now")]), 1)
    assert have() == [("x", 1, "p"), ("y", 2, None)]


def test_sink_survives_a_batch_that_breaks_off(spark, tmp_path, monkeypatch):
    rows = [(f"k{i}", i, "v") for i in range(40)]
    for i in range(4):
        spark.createDataFrame(rows[i * 10 : i * 10 + 12], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    commit, broken = LedgerSink.commit, []

    def breaks(self, spark, number, *rest):
        if number == 2 and not broken:
            broken.append(number)
            raise RuntimeError("lost")
        commit(self, spark, number, *rest)

    monkeypatch.setattr(LedgerSink, "commit", breaks)
    sink = LedgerSink(str(tmp_path / "sink"), "id", SCHEMA)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="lost"):
        run()
    assert broken
    assert sink.read(spark).count() < 40  # what broke off does not count
    run()
    assert sorted(tuple(r) for r in sink.read(spark).select("id", "a", "b").collect()) == sorted(rows)
    assert sink.ledger(spark).count() == 4


def test_health_in_order_of_event_time(spark, tmp_path):
    """Rows out of order over several micro-batches give what the batch rule gives; rows later than the delay are dropped."""
    r = random.Random(8)
    events = [(i, i % 3, f"2024-01-01 00:{i:02d}:00", (i * 7) % 5 < 2, i % 11 == 0, i % 17 == 3, i % 13 == 5, i == 50) for i in range(60)]
    shuffled = sorted(events, key=lambda e: (e[0] + r.randint(0, 14), e[0]))
    assert shuffled != events
    schema = "event_id long, user_id long, ts string, failed boolean, signal boolean, hard boolean, blocked boolean, retired boolean"
    typed = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    for at in range(0, 60, 12):
        typed(shuffled[at : at + 12]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    far = [(99, 77, "2024-01-02 00:00:00", False, False, False, False, False)]
    late = [(98, 0, "2024-01-01 00:00:30", True, True, True, True, True)]
    df = typed(events)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run():
        q = health.ordered_changes(stream, "user_id", "20 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)

    run()
    typed(far).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    typed(late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    states = health.next_state(df, ["user_id"], [F.col("ts"), F.col("event_id")], *(F.col(c) for c in ("failed", "signal", "hard", "blocked", "retired")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = states.withColumn("from_state", F.coalesce(F.lag("state").over(w), F.lit("probing"))).where("from_state <> state").select("user_id", "event_id", "from_state", "state")
    got = spark.read.parquet(str(tmp_path / "out")).where("key <> 77")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shards_overflow_and_bounds(spark, tmp_path):
    rows = [(f"{i * 7919 % 256:02x}{i:06x}aa", "é" * (i % 40), i) for i in range(300)]
    products = spark.createDataFrame(rows, "id string, name string, n long")
    dealt = publication.shards(products, "id", 4, most_bytes=3000)
    found = publication.write(publication.documents(dealt, "g1"), str(tmp_path / "d"))
    files = {r.shard: r for r in found.collect()}
    assert sum(r.product_count for r in files.values()) == 300
    assert max(r.bytes for r in files.values()) <= 3000
    assert sorted(files) == list(range(len(files)))
    texts = {int(m[1]): p.read_text() for p in (tmp_path / "d").rglob("part-*") if (m := re.search(r"shard=(\d+)", str(p)))}
    assert sorted(x["id"] for t in texts.values() for x in json.loads(t)["products"]) == sorted(r[0] for r in rows)
    assert all([x["id"] for x in json.loads(t)["products"]] == sorted(x["id"] for x in json.loads(t)["products"]) for t in texts.values())
    assert publication.differences(found, publication.manifest(spark, str(tmp_path / "d")), "g1").collect() == []
    changed = found.withColumn("sha256", F.when(F.col("shard") == 1, "x").otherwise(F.col("sha256"))).where("shard <> 2")
    assert sorted(map(tuple, publication.differences(changed, found, "g1").collect())) == [(1, "digest"), (2, "unexpected")]
    assert {r.reason for r in publication.differences(found, found, "g2").collect()} == {"generation"}
    with pytest.raises(ValueError, match="of 5 at most"):
        publication.shards(products, "id", 4, most_bytes=3000, most_shards=5)
    with pytest.raises(Exception, match="larger than a segment"):
        publication.shards(products, "id", 4, most_bytes=600).collect()


def test_digests_do_not_hang_on_order(spark):
    rows = [(i, {"b": i, "a": -i}, [(i, "x")]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, m map<string,long>, l array<struct<z:long,y:string>>")
    other = df.select(F.expr("transform(l, x -> named_struct('y', x.y, 'z', x.z))").alias("l"), F.map_from_entries(F.reverse(F.map_entries("m"))).alias("m"), "id").repartition(7)
    root = lambda d: tuple(canonical.tree_root(canonical.row_digests(d)).first())
    assert root(df) == root(other)
    assert root(df)[1] == 3000
    assert root(df.union(df.limit(1)))[0] != root(df)[0]
    assert root(df.withColumn("m", F.when(F.col("id") == 5, F.create_map(F.lit("a"), F.lit(0).cast("long"))).otherwise(F.col("m"))))[0] != root(df)[0]
    assert root(df.limit(0))[1] == 0


def plain_address(value, hosts=()):
    """By the standard library, one address at a time."""
    import ipaddress
    import posixpath
    from urllib.parse import parse_qsl, quote, urlencode

    def host_of(h):
        h = h.strip().rstrip(".").lower()
        if not h or h in ("localhost", "localhost.localdomain") or h.endswith(".localhost"):
            raise ValueError
        try:
            ip = ipaddress.ip_address(h.strip("[]"))
        except ValueError:
            if "." not in h:
                raise
            return h.encode("idna").decode("ascii")
        if not ip.is_global:
            raise ValueError
        return ip.compressed

    try:
        p = urlsplit((value or "").strip())
        if p.scheme not in ("http", "https") or "@" in p.netloc:
            return ""
        port, host = p.port, host_of(p.hostname or "")
    except ValueError:
        return ""
    if hosts and not any(host == h or host.endswith("." + h) for h in hosts):
        return ""
    shown = f"[{host}]" if ":" in host else host
    if port and port != {"http": 80, "https": 443}[p.scheme]:
        shown += f":{port}"
    path = quote(posixpath.normpath(p.path or "/"), safe="/%:@-._~!$&'()*+,;=")
    path += "/" if p.path.endswith("/") and not path.endswith("/") else ""
    pairs = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in structure.publicity.CAMPAIGN_KEYS]
    query = urlencode(sorted(pairs, key=lambda x: (x[0].lower(), x[1])))
    return f"{p.scheme}://{shown}{path}" + (f"?{query}" if query else "")


def test_public_addresses(spark):
    r = random.Random(12)
    schemes = ["https://"] * 8 + ["http://"] * 4 + ["HTTPS://", "ftp://", "//", "", "mailto:"]
    hosts = ["shop.example.com", "Shop.Example.COM.", "münchen.example.de", "例え.jp", "localhost", "a.localhost", "single", "10.0.0.1", "8.8.8.8", "192.168.1.1", "1.2.3", "127.0.0.1", "[2001:4860:4860::8888]", "[::1]", "[fe80::1]", "a..b.com", "x" * 64 + ".com", "172.32.0.1", "100.64.0.1", "203.0.113.5", "", "user@x.com", "u:p@x.com"]
    ports = [""] * 8 + [":80", ":443", ":8080", ":0", ":65536", ":"]
    paths = ["", "/", "/a/b", "/a/../b", "/../../x/", "/a/./b/", "//a//b", "///a", "/a b", "/é/ü", "/%41/%zz", "/a;b=c,d", "/..", "/a/..", "/x\\y", "/\U0001f600"]
    queries = ["", "?", "?b=2&a=1", "?utm_source=x&q=1", "?a=1&A=0&a=0", "?x", "?x=&=y", "?q=a+b%20c", "?q=%zz%41", "?k=é*~", "?FBCLID=1", "?a=b=c&&d"]
    rows = [(i, "".join(r.choice(x) for x in (schemes, hosts, ports, paths, queries)) + r.choice(["", "", "#f", " "])) for i in range(900)]
    df = spark.createDataFrame([*rows, (-1, None)], "i int, a string")
    got = by(structure.publicity.public_addresses(df, "a"), "i", "public")
    want = {i: plain_address(a) for i, a in rows} | {-1: ""}
    assert {dict(rows).get(i): (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert sum(x != "" for x in want.values()) > 200
    inside = by(structure.publicity.public_addresses(df, "a", hosts=["example.com", "例え.jp"]), "i", "public")
    assert inside == {i: plain_address(a, ("example.com", "xn--r8jz45g.jp")) for i, a in rows} | {-1: ""}
    with pytest.raises(ValueError, match="no public host"):
        structure.publicity.public_addresses(df, "a", hosts=["jp"])
