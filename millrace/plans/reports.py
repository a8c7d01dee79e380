"""Laboratory reports, documents, recovered prices and ratings.

Reports are written from parts by expressions that both engines read; the SQL knows what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.sources import labs, pages, recovery
from millrace.sources.tables import spread, table

_REPORT = """concat('Laboratory: Lab ', p_size, '\n\nReport date: 2024-01-', 10 + p_partkey % 20, '\nBatch # B-', p_partkey, '/x\n', CASE WHEN p_partkey % 3 = 0 THEN concat('Sample ID: S', p_partkey, '\n') ELSE '' END,
 'THC-A   result ', p_partkey % 90, '.5 %  LOQ 0.1%\n', 'Limonene\n', p_partkey % 7, ' %\n', 'CBD ', p_size, '% ', p_partkey % 5, '%\n', 'CBG LOD 0.2%\n', CASE WHEN p_partkey % 4 = 0 THEN 'CBN 140%\n' ELSE concat('CBN ', p_size, '% uncertainty 0.5%\n') END,
 'THC-A result 99%\n', 'Total cannabinoids: ', p_partkey % 200, '% and later total cannabinoids 7%\n')"""


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr("p_partkey", f"{_REPORT} AS report")


@query("""SELECT p_partkey, 'cannabinoid' AS category, 'thca' AS name, CAST(p_partkey % 90 + 0.5 AS DOUBLE) AS value, 'text_line:' || CAST(5 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS location FROM part
UNION ALL SELECT p_partkey, 'terpene', 'limonene', CAST(p_partkey % 7 AS DOUBLE), 'text_line:' || (6 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) || '-' || (7 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) FROM part
UNION ALL SELECT p_partkey, 'cannabinoid', 'cbn', CAST(p_size AS DOUBLE), 'text_line:' || (10 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) FROM part WHERE p_partkey % 4 <> 0""")
def lab_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The first value of each analyte in reports: results before limits, values on the next line."""
    return labs.metrics(labs.readings(_reports(spark, folder), "p_partkey", "report"), "p_partkey")


@query("""WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS d FROM part)
SELECT p_partkey, 'text_line:' || (8 + d) AS location, 'ignored ambiguous analyte row with unlabeled percentages' AS warning FROM o UNION ALL SELECT p_partkey, 'text_line:' || (9 + d), 'ignored limit-only analyte row' FROM o
UNION ALL SELECT p_partkey, 'text_line:' || (10 + d), 'ignored impossible measured percentage' FROM o WHERE p_partkey % 4 = 0""")
def lab_warnings(spark: SparkSession, folder: str) -> DataFrame:
    found = labs.readings(_reports(spark, folder), "p_partkey", "report")
    return found.where("warning IS NOT NULL").select("p_partkey", "location", "warning").distinct()


@query("""SELECT p_partkey, ': Lab ' || p_size AS laboratory, ': 2024-01-' || (10 + p_partkey % 20) AS report_date, CASE WHEN p_partkey % 3 = 0 AND p_partkey > 9 THEN 'S' || p_partkey ELSE '' END AS sample_id, 'B-' || p_partkey || '/x' AS batch_id, CASE WHEN p_partkey % 200 <= 100 THEN CAST(p_partkey % 200 AS DOUBLE) ELSE 7.0 END AS total_cannabinoids FROM part""")
def lab_fields(spark: SparkSession, folder: str) -> DataFrame:
    """A report's header fields and totals. A mark after a name is part of a field that may begin with any character."""
    return labs.fields(_reports(spark, folder), "p_partkey", "report").select("p_partkey", "laboratory", "report_date", "sample_id", "batch_id", "total_cannabinoids")


_JSON = """CASE WHEN p_partkey % 11 = 4 THEN '{broken' ELSE concat('{"report": {"rows": [{"analyte": "THCA", "result": "', p_size, '", "unit": "%"}, {"compound": "CBD", "value": ', p_partkey % 300, ', "units": "pct"}, {"name": "Limonene", "percentage": ', p_partkey % 9, '},
 {"analyte": "THC-A", "result": "', p_size + p_partkey % 2, '%"}, {"analyte": "CBG", "result": 3, "unit": "mg"}], "a b": {"label": "Total Terpenes", "percent": "2.5"}, "deep": ', repeat('{"n": [', 100), '{"terpene": "',
 CASE p_size % 6 WHEN 0 THEN 'Beta Caryophyllene' WHEN 1 THEN 'beta_pinene' WHEN 2 THEN ' Alpha-  Pinene' WHEN 3 THEN 'Pinenes' WHEN 4 THEN 'PINENE (all)' ELSE 'supinene' END, '", "percent": ', p_partkey % 7, '.25}', repeat(']}', 100), '}, "laboratory": "Lab ', p_size,
 '", "tests": {"Report Date": "2024-02-', 10 + p_partkey % 18, '", "Batch": ', 1000 + p_partkey, ', "nothing": null, "flag": true}}') END"""


@query("""SELECT p_partkey, 'cannabinoids.thca' AS field, CAST(p_size AS DOUBLE) AS value, 'json_path:$.report.rows[0].result' AS location, CAST(p_partkey % 2 AS INTEGER) AS conflicts FROM part WHERE p_partkey % 11 <> 4 UNION ALL SELECT p_partkey, 'cannabinoids.cbd', CAST(p_partkey % 300 AS DOUBLE), 'json_path:$.report.rows[1].value', 0 FROM part WHERE p_partkey % 11 <> 4 AND p_partkey % 300 <= 100
UNION ALL SELECT p_partkey, 'terpenes.limonene', CAST(p_partkey % 9 AS DOUBLE), 'json_path:$.report.rows[2].percentage', 0 FROM part WHERE p_partkey % 11 <> 4 UNION ALL SELECT p_partkey, 'total_terpenes', 2.5, 'json_path:$.report["a b"].percent', 0 FROM part WHERE p_partkey % 11 <> 4
UNION ALL SELECT p_partkey, 'terpenes.' || ['beta-caryophyllene', 'beta-pinene', 'alpha-pinene', '', 'pinene'][1 + p_size % 6], p_partkey % 7 + 0.25, 'json_path:$.report.deep' || repeat('.n[0]', 100) || '.percent', 0 FROM part WHERE p_partkey % 11 <> 4 AND p_size % 6 NOT IN (3, 5)""")
def lab_structured(spark: SparkSession, folder: str) -> DataFrame:
    """Analytes of nested JSON, also a hundred levels deep: the first value of each, with its path, and how many later ones
    differ. Labels count by whole words, whatever separates these."""
    rows = spread(table(spark, folder, "part"), "p_partkey").selectExpr("p_partkey", f"{_JSON} AS payload")
    return labs.first_values(labs.structured(rows, "p_partkey", "payload"), "p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 4 THEN '' ELSE ': Lab ' || p_size END AS laboratory, CASE WHEN p_partkey % 11 = 4 THEN '' ELSE ': 2024-02-' || (10 + p_partkey % 18) END AS report_date, CASE WHEN p_partkey % 11 = 4 THEN '' ELSE CAST(1000 + p_partkey AS VARCHAR) END AS batch_id FROM part""")
def lab_json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Header fields of JSON reports from their other texts and numbers."""
    rows = spread(table(spark, folder, "part"), "p_partkey").selectExpr("p_partkey", f"{_JSON} AS payload")
    return labs.structured_fields(rows, "p_partkey", "payload").select("p_partkey", "laboratory", "report_date", "batch_id")


_CONTENT = """CASE p_partkey % 6 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN concat('<div>Batch ', p_partkey, '</div><p>THCA <b>', p_size, '%</b></p><script>x</script>') WHEN 2 THEN concat('%PDF-1.4 (THCA ', p_size, '\\\\(a\\\\)%) Tj [(CBD) 3 (', p_partkey, ')] TJ') WHEN 3 THEN '%PDF-1.4 /Filter /FlateDecode' WHEN 4 THEN '%PDF-1.4 none' ELSE 'plain' END"""
_MEDIA = "CASE p_partkey % 6 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'TEXT/HTML' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'x/y' WHEN 4 THEN 'application/pdf' ELSE CASE WHEN p_partkey % 4 = 1 THEN 'image/png' ELSE '' END END"


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' WHEN 3 THEN 'unsupported_format' WHEN 4 THEN 'unsupported_scanned' ELSE CASE WHEN p_partkey % 4 = 1 THEN 'unsupported_format' ELSE 'text' END END AS route,
 CASE p_partkey % 6 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN 'Batch ' || p_partkey || chr(10) || 'THCA ' || p_size || '%' WHEN 2 THEN 'THCA ' || p_size || '(a)%' || chr(10) || 'CBD' || chr(10) || p_partkey WHEN 5 THEN CASE WHEN p_partkey % 4 = 1 THEN '' ELSE 'plain' END ELSE '' END AS text FROM part""")
def document_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of several media as text, or why they have none."""
    rows = table(spark, folder, "part").selectExpr("p_partkey", f"CAST({_CONTENT} AS BINARY) AS content", f"{_MEDIA} AS media", "CASE WHEN p_partkey % 6 = 3 THEN 'https://x/a.PDF?x=1' ELSE '' END AS url")
    found = labs.texts(rows, "p_partkey", "content", "media", "url")
    return found.select("p_partkey", "route", F.rtrim(F.regexp_replace("text", r"\n+$", "")).alias("text"))


_KIND = "CASE p_partkey % 7 WHEN 0 THEN 'Terpene lab panel' WHEN 1 THEN 'terpene sheet' WHEN 2 THEN 'COA' WHEN 3 THEN 'potency' WHEN 4 THEN 'photo' WHEN 5 THEN 'Certificate' ELSE '' END"


@query(f"SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'combined_lab_report' WHEN 1 THEN 'terpene_report' WHEN 2 THEN 'coa' WHEN 3 THEN 'coa' WHEN 5 THEN 'coa' ELSE 'unknown' END AS kind FROM (SELECT *, {_KIND} FROM part)")
def document_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", labs.kind(F.expr(_KIND)).alias("kind"))


_PAGE = """concat('<html><a href="/files/coa-', p_partkey, '.pdf?utm_source=x">Batch No: B', p_partkey, ' 3.5 g</a> <a title="Lab report" href="/lab/', p_partkey % 50, '">see</a><a href="/files/coa-', p_partkey, '.pdf">again</a><a href="/about">About</a><a href="/x.pdf?token=1">COA</a>',
 CASE p_partkey % 5 WHEN 0 THEN concat('<span class="price">', MARK, p_size, '.50 <b>was</b> ', MARK, p_size + 10, '</span>') WHEN 1 THEN concat('<p>Our price: <b>$', p_size, '</b> now $', p_size + 2, '</p>') WHEN 2 THEN concat('<script>{{"price": ', 1000 + p_size, ', "currency_minor_unit": 2}}</script>')
 WHEN 3 THEN concat('<script>{{"lowPrice": "', p_size, '.25"}}</script>') ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN concat('<script>{{"ratingValue": "4.5", "x": 1, "reviewCount": ', p_size, '}}</script>') WHEN 1 THEN concat('<script>{{"review_count": ', p_size, ', "rating": 3}}</script>')
 WHEN 2 THEN concat('<div>Rated <b>4.25</b> based on ', p_size, CASE WHEN p_size % 2 = 0 THEN '&nbsp;customer&#x20;reviews</div>' ELSE ' customer reviews</div>' END)
 ELSE CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('<i data-rating=""></i><i data-x data-average-rating="', p_size % 5 + 1, '" Data-Rating-Count="', p_partkey, '"></i>') END END, CASE p_partkey % 3 WHEN 0 THEN concat('<i data-price-amount="', p_size, '.75">') WHEN 1 THEN concat('<bdi class="amount"><span>', MARK, '</span>', p_size, '</bdi>') ELSE concat('{{"formattedPrice": "$ ', p_size, '.10"}}') END)""".replace("{{", "{").replace("}}", "}").replace("MARK", "CASE p_size % 5 WHEN 0 THEN '&#36;' WHEN 1 THEN '$&nbsp;' WHEN 2 THEN '&dollar;' WHEN 3 THEN '&#x24; ' ELSE '$' END")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr("p_partkey", "'https://shop.example.com/p/' AS url", f"{_PAGE} AS html")


@query("""SELECT p_partkey, 'https://shop.example.com/files/coa-' || p_partkey || '.pdf' AS target, 'coa' AS kind, 'Batch No: B' || p_partkey || ' 3.5 g' AS title, 'B' || p_partkey AS batch, 3.5::DOUBLE AS grams, true AS is_pdf FROM part WHERE p_partkey > 9
UNION ALL SELECT p_partkey, 'https://shop.example.com/files/coa-' || p_partkey || '.pdf', 'coa', 'Batch No: B' || p_partkey || ' 3.5 g', '', 3.5, true FROM part WHERE p_partkey <= 9
UNION ALL SELECT p_partkey, 'https://shop.example.com/lab/' || (p_partkey % 50), 'coa', 'see', '', NULL, false FROM part""")
def html_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that pages link to; expiring addresses are none."""
    return recovery.html_documents(_pages(spark, folder), "p_partkey", "url", "html")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size WHEN 2 THEN (1000 + p_size) / 100.0 WHEN 3 THEN p_size + 0.25 END::DOUBLE AS price FROM part""")
def product_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The price of a product's page: in price elements, behind words, in JSON with its minor units."""
    return recovery.product_price(_pages(spark, folder), "html").select("p_partkey", "price")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_size WHEN p_partkey % 3 = 2 THEN p_size + 0.1 END::DOUBLE AS shown, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.75 END::DOUBLE AS attribute FROM part""")
def shown_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices that pages show in amounts, scripts and attributes."""
    return _pages(spark, folder).select("p_partkey", recovery.shown_price("html").alias("shown"), recovery.attribute_price("html").alias("attribute"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 4.5 WHEN 1 THEN 3 WHEN 2 THEN 4.25 ELSE CASE WHEN p_size % 3 > 0 THEN p_size % 5 + 1 END END::DOUBLE AS score, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_size AS BIGINT) WHEN p_size % 3 > 0 THEN p_partkey END AS count FROM part""")
def embedded_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings in scripts, in either order, in data attributes and in words."""
    return recovery.ratings(_pages(spark, folder), "html", "r").select("p_partkey", "r.*")


_NESTED = """CASE WHEN p_partkey % 13 = 5 THEN '[' ELSE concat('{"product_id": ', p_partkey, ', "title": "Item ', p_partkey, '", "variants": [{"variant_id": "v1", "variant": "3.5 g", "documents": [{"url": "/d/', p_partkey, '.pdf", "batch": "B', p_partkey % 4, '"}, {"url": "/d/', p_partkey, '.pdf"}]},
 {"variant_id": "v2", "coa_url": "/c/', p_partkey % 6, '", "url": "/page"}], "url": "/item", "lab_reports": {"type": "terpene", "href": "https://lab.example.com/t?utm_x=1"}}') END"""


@query("""WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part WHERE p_partkey % 13 <> 5)
SELECT p_partkey, '$.variants[0].documents[0].url' AS path, 'https://shop.example.com/d/' || k || '.pdf' AS target, 'unknown' AS kind, k AS product_id, 'v1' AS variant_id, 'B' || (p_partkey % 4) AS batch_id, 3.5::DOUBLE AS grams, NULL AS product_url FROM p
UNION ALL SELECT p_partkey, '$.variants[1].coa_url', 'https://shop.example.com/c/' || (p_partkey % 6), 'coa', k, 'v2', NULL, NULL, '/page' FROM p UNION ALL SELECT p_partkey, '$.lab_reports.href', 'https://lab.example.com/t', 'combined_lab_report', k, NULL, NULL, NULL, NULL FROM p""")
def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in nested JSON, with what they inherit."""
    rows = table(spark, folder, "part").selectExpr("p_partkey", "'https://shop.example.com/api' AS url", f"{_NESTED} AS payload")
    return recovery.json_documents(rows, "p_partkey", "url", "payload").select("p_partkey", "path", "target", "kind", "product_id", "variant_id", "batch_id", "grams", "product_url")


_BLOCK = """concat(repeat('{"@graph": [', 120), '{"name": "P', p_partkey, '", "@type": ', CASE p_partkey % 4 WHEN 0 THEN '"PRODUCT"' WHEN 1 THEN '["Thing", "product"]' WHEN 2 THEN '"Product"' ELSE '"Thing"' END, ', "url": "/p/', p_partkey, '", "offers": ',
 CASE WHEN p_size % 5 = 0 THEN 'null' ELSE concat('{"@type": "AggregateOffer", "lowPrice": ', p_size, ', "offers": [{"price": "', p_size + 2, '.50", "availability": "https://schema.org/InStock", "name": "3.5 g"}, [{"price": "", "lowPrice": ', p_size + 1, ', "highPrice": ', p_size + 9, ', "url": "/o"}]]}') END, '}', repeat(']}', 120))"""


def _structured_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose products lie 120 graphs deep; every second one writes its quotes as entities, some have a broken block first."""
    rows = table(spark, folder, "part").selectExpr("p_partkey", "p_size", f"{_BLOCK} AS block")
    return rows.selectExpr("p_partkey", """concat('<html><script>x</script>', CASE WHEN p_partkey % 3 = 0 THEN '<script type="application/ld+json">{broken</script>' ELSE '' END, '<script type="application/ld+json">', CASE WHEN p_size % 2 = 0 THEN replace(block, '"', '&quot;') ELSE block END, '</script>') AS html""")


@query("""WITH p AS (SELECT *, 'P' || p_partkey AS name FROM part WHERE p_partkey % 4 <> 3) SELECT p_partkey, 0 AS place, name, (p_size + 2) || '.50' AS price, CAST(NULL AS VARCHAR) AS low_price, CAST(NULL AS VARCHAR) AS high_price, 'InStock' AS availability, '/p/' || p_partkey AS url, '3.5 g' AS size FROM p WHERE p_size % 5 <> 0
UNION ALL SELECT p_partkey, 1, name, CAST(p_size + 1 AS VARCHAR), CAST(p_size + 1 AS VARCHAR), CAST(p_size + 9 AS VARCHAR), '', '/o', '' FROM p WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, 0, name, NULL, NULL, NULL, '', '/p/' || p_partkey, '' FROM p WHERE p_size % 5 = 0""")
def structured_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Offers of products in structured data, 120 graphs deep, aggregates opened."""
    return pages.structured_offers(_structured_pages(spark, folder), "p_partkey", "html", any_nested=False)


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size + 1 END::DOUBLE AS price, CASE WHEN p_size % 5 <> 0 THEN 'InStock' END AS availability FROM part WHERE p_partkey % 4 <> 3")
def least_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The least of all prices of a page's structured offers, and the first availability."""
    return recovery.least_price(pages.structured_offers(_structured_pages(spark, folder), "p_partkey", "html"), "p_partkey")
