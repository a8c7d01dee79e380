"""Column functions on single values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import addresses, extract, hashing, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "clean"), [(None, ""), ("  a \n b ", "a b"), ("a &amp; b", "a & b"), ("ﬁne", "fine"), ("", "")])
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text(F.lit(raw).cast("string"))) == clean


@pytest.mark.parametrize(("raw", "key"), [("Éclair-2 / B", "eclair 2 b"), ("STRASSE", "strasse"), ("straße", "strasse"), (None, "")])
def test_search_key(spark, raw, key):
    assert one(spark, text.search_key(F.lit(raw).cast("string"))) == key


def test_search_text_drops_all_punctuation(spark):
    assert one(spark, text.search_text(F.lit("Água, (x) $5+!"))) == "agua x 5"


def test_natural_order(spark):
    names = ["Strain 10", "strain 2", "Éclair", "Eclair 1", "Strain 02"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key("n"), "n").collect()
    assert [r.n for r in rows] == ["Éclair", "Eclair 1", "Strain 02", "strain 2", "Strain 10"]


def test_strip_suffixes_keeps_something(spark):
    assert one(spark, text.strip_suffixes(F.lit("Blue - Premium | indoor"), ["indoor", "premium"])) == "Blue"
    assert one(spark, text.strip_suffixes(F.lit("premium indoor"), ["indoor", "premium"])) == "premium"


def test_other_text(spark):
    assert one(spark, text.strip_tags(F.lit("<p>a<br>b &lt; c</p>"))) == "a b < c"
    assert one(spark, text.name_key(F.lit("A & B, Inc."))) == "a and b inc"
    assert one(spark, text.slug_title(F.lit("https://x.example.com/p/blue-dream_2.html?x=1"))) == "Blue Dream 2"
    assert one(spark, text.bounded(F.lit("a  bcdef"), 4)) == "a bc"


@pytest.mark.parametrize(("raw", "value"), [("$1,234.50", 1234.5), ("nan", None), ("", None), (None, None), ("-1", None), ("101", 101.0)])
def test_decimal(spark, raw, value):
    got = one(spark, numbers.decimal(F.lit(raw).cast("string"), 0, 5000))
    assert (None if got is None else float(got)) == value


@pytest.mark.parametrize(("raw", "value"), [("25.0%", 25.0), ("ND", 0.0), ("below LOQ", 0.0), ("140%", None), ("none", None), ("12", 12.0)])
def test_percent(spark, raw, value):
    got = one(spark, numbers.percent(F.lit(raw)))
    assert (None if got is None else float(got)) == value


def test_rounding(spark):
    assert one(spark, numbers.half_up(F.lit("0.125").cast("decimal(5,3)"), 2)) == 0.13
    assert one(spark, numbers.half_even(F.lit("0.125").cast("decimal(5,3)"), 2)) == 0.12


def test_rating_pair_is_both_or_none(spark):
    assert one(spark, numbers.rating_pair(F.lit("4.5"), F.lit("10"))).asDict() == {"score": 4.5, "count": 10}
    assert one(spark, numbers.rating_pair(F.lit("4.5"), F.lit("1.5"))) is None
    assert one(spark, numbers.rating_pair(F.lit("5.1"), F.lit("3"))) is None


@pytest.mark.parametrize(
    ("label", "grams"),
    [("3.5 grams", 3.5), ("1/8 oz", 3.5), ("Half pound", 224.0), ("quarter", 7.0), ("1/4", 7.0), ("two ounces", 56.0), ("28g", 28.0), ("13.5g", None), ("choose size", None), ("zip", 28.0), ("1/2 lb", 224.0)],
)
def test_label_grams(spark, label, grams):
    got = one(spark, extract.label_grams(F.lit(label)))
    assert (None if got is None else got.grams) == grams


def test_snap(spark):
    assert one(spark, extract.snap(F.lit(28.35))) == 28.0
    assert one(spark, extract.snap(F.lit(30.0))) == 30.0


def test_weight_needs_agreement(spark):
    assert one(spark, extract.weight(F.lit(28.35), F.lit("1 oz"))).asDict() == {"grams": 28.0, "method": "agreed"}
    assert one(spark, extract.weight(F.lit(7.0), F.lit("1 oz"))).method == "conflict"
    assert one(spark, extract.weight(F.lit(7.0), F.lit("bag"))).method == "unlabelled"


@pytest.mark.parametrize(("state", "value"), [("in stock", True), ("not in stock", False), ("Sold Out", False), ("true", True), ("false", False), ("later", None), (None, None), ("not very available", False)])
def test_stock(spark, state, value):
    assert one(spark, extract.stock(F.lit(state).cast("string"))).in_stock is value


@pytest.mark.parametrize(
    ("url", "product", "document"),
    [
        ("HTTPS://X.example.com//a//b/?utm_source=q&b=2&a=1#f", "https://x.example.com/a/b", "https://x.example.com/a/b?a=1&b=2"),
        ("https://x.example.com", "https://x.example.com/", "https://x.example.com/"),
        ("https://x.example.com/a?token=1", "https://x.example.com/a", ""),
        ("https://u:p@x.example.com/a", "https://u:p@x.example.com/a", ""),
        ("ftp://x.example.com/a", "", ""),
        (None, "", ""),
    ],
)
def test_addresses(spark, url, product, document):
    c = F.lit(url).cast("string")
    assert one(spark, addresses.product_address(c)) == product
    assert one(spark, addresses.document_address(c)) == document


@pytest.mark.parametrize(
    ("url", "variant"),
    [
        ("https://x.example.com/a/?sku=1&variant=2", "https://x.example.com/a?variant=2"),
        ("https://x.example.com/a?variation_id=7&attribute_pa_size=half+oz&variant=", "https://x.example.com/a?attribute_pa_size=half+oz&variation_id=7"),
        ("https://x.example.com/a?attribute_size=1%2f8&Variant=b~*", "https://x.example.com/a?Variant=b~%2A&attribute_size=1%2F8"),
        ("https://x.example.com/a?variant=%zz", "https://x.example.com/a?variant=%25zz"),
    ],
)
def test_variant_address(spark, url, variant):
    assert one(spark, addresses.variant_address(F.lit(url))) == variant


@pytest.mark.parametrize(("url", "target"), [("https://X.example.com/Shop/a?b=1#c", "https://X.example.com/Shop/a"), ("https://x.example.com/page?b=1#c", "https://x.example.com/page?b=1"), ("text", "text"), (None, ""), ("https://x.example.com", "https://x.example.com/")])
def test_detail_target(spark, url, target):
    assert one(spark, addresses.detail_target(F.lit(url).cast("string"))) == target


@pytest.mark.parametrize("raw", ["plain", "Été À ﬁn", "ΑΪΰς Ξ", "Йёж", "ﬀ½ ①", "한국 日本", "straße ẞ ΣΑΣ", "a\u0301b", "ÅÆØ ŁĦ", "İıſ", "﷼ ﬃ"])
def test_folding_equals_the_library(spark, raw):
    import unicodedata

    want = "".join(x for x in unicodedata.normalize("NFKD", raw.casefold()) if not unicodedata.combining(x))
    assert one(spark, text.fold(F.lit(raw))).replace("ı", "i") == want.replace("ı", "i") or one(spark, text.fold(F.lit(raw))) == "".join(x for x in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(x)).casefold()


@pytest.mark.parametrize(("raw", "clean"), [("a &amp;lt; b", "a &lt; b"), ("x &copy 1", "x © 1"), ("q & a &#39;s&#x27;", "q & a 's'"), ("AT&T", "AT&T"), ("&eacute;&nbsp;z", "é z"), ("e\u0301", "é")])
def test_entities(spark, raw, clean):
    assert one(spark, text.clean_text(F.lit(raw))) == clean


def test_joined_links(spark):
    base = F.lit("https://x.example.com/a/b?q")
    for link, full in [("/c", "https://x.example.com/c"), ("d", "https://x.example.com/a/d"), ("//y.example.com/z", "https://y.example.com/z"), ("mailto:a@b", ""), ("#x", "")]:
        assert one(spark, addresses.joined(base, F.lit(link))) == full


def test_public(spark):
    for url, ok in [("https://x.example.com/a", True), ("http://localhost/a", False), ("http://127.0.0.1/", False), ("https://a@x.example.com/", False), ("x", False)]:
        assert one(spark, addresses.public(F.lit(url))) is ok


def test_digest_counts_null_as_empty(spark):
    assert one(spark, hashing.digest(F.lit("a"), F.lit(None).cast("string"))) == one(spark, hashing.digest(F.lit("a"), F.lit("")))
    assert one(spark, hashing.digest(F.lit("a"), F.lit("b"))) != one(spark, hashing.digest(F.lit("ab"), F.lit("")))
