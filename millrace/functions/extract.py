"""Facts from labels and descriptions, by ordered patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.positions import around, cut, let, spots
from millrace.functions.text import clean_text, column, search_key

# Package labels and their grams.
GRAMS = r"(?i)(?<![\d.-])(0\.5|1|2|3\.5|4|7|14|28|56|112)\s*(?:g|grams?)\b"
POUNDS = r"(?i)(?<![\d.-])(1/4|1/2|1|2|4)\s*(?:lb|lbs|pounds?)\b"
WORD_POUNDS = r"(?i)\b(quarter|half|one|two|four)\s+pounds?\b"
OUNCES = r"(?i)(?<![\d.-])(1/8|1/4|1/2|1|2|4)\s*(?:st|nd|rd|th)?\s*(?:oz|ounces?)\b"
BARE_FRACTION = r"(?i)(?<![\d.-])(1/8|1/4|1/2)\s*(?:th|st|nd|rd)?\b"
WORD_WEIGHT = r"(?i)\b(eighth|quarter|half\s+ounce|half[- ]?oz|ounce|one\s+ounce|two\s+ounces?|four\s+ounces?|zip)\b(?!\s*(?:lb|lbs|pounds?)\b)"
POUND_GRAMS = {"1/4": 112.0, "1/2": 224.0, "1": 448.0, "2": 896.0, "4": 1792.0, "quarter": 112.0, "half": 224.0, "one": 448.0, "two": 896.0, "four": 1792.0}
OUNCE_GRAMS = {"1/8": 3.5, "1/4": 7.0, "1/2": 14.0, "1": 28.0, "2": 56.0, "4": 112.0}
WORD_GRAMS = {"eighth": 3.5, "quarter": 7.0, "half ounce": 14.0, "half oz": 14.0, "ounce": 28.0, "one ounce": 28.0, "two ounces": 56.0, "two ounce": 56.0, "four ounces": 112.0, "four ounce": 112.0, "zip": 28.0}
LEAST_GRAMS, MOST_GRAMS = 0.05, 5000.0
STANDARD_GRAMS = [0.5, 1.0, 2.0, 3.5, 4.0, 7.0, 14.0, 28.0, 56.0, 112.0, 224.0, 448.0, 896.0, 1792.0]
#: Phrases that deny and that affirm stock.
OUT_OF_STOCK = r"\b(?:out\s+of\s+stock|outofstock|sold\s+out|unavailable|not(?:\s+\w+){0,2}\s+(?:available|in\s+stock))\b"
IN_STOCK = r"\b(?:in\s+stock|instock|available(?:\s+for\s+order)?)\b"


def lookup(key: Column, table: dict[str, float]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def label_grams(label: Column | str) -> Column:
    """struct(grams, label): the first pattern, in the order above, that the label holds."""
    text = column(label)
    out = F.lit(None).cast("struct<grams:double,label:string>")
    rules = [(GRAMS, None), (POUNDS, POUND_GRAMS), (WORD_POUNDS, POUND_GRAMS), (OUNCES, OUNCE_GRAMS), (BARE_FRACTION, OUNCE_GRAMS), (WORD_WEIGHT, WORD_GRAMS)]
    for pattern, table in reversed(rules):
        found = F.regexp_extract(text, pattern, 1)
        key = F.regexp_replace(F.lower(found), r"[\s-]+", " ")
        grams = found.try_cast("double") if table is None else lookup(key, table)
        out = F.when(found != "", F.struct(grams.alias("grams"), F.trim(F.regexp_extract(text, pattern, 0)).alias("label"))).otherwise(out)
    return out


def snap(value: Column, standards: list[float] = STANDARD_GRAMS) -> Column:
    """The nearest standard if within 0.02 or 2 %, else the value itself; of two as near, the smaller."""
    near = F.array_min(F.transform(F.array(*map(F.lit, standards)), lambda s: F.struct(F.abs(s - value).alias("d"), s.alias("s"))))
    return F.when(near["d"] <= F.greatest(F.lit(0.02), near["s"] * 0.02), near["s"]).otherwise(value)


def weight(value: Column, label: Column | str) -> Column:
    """struct(grams, method): the label's grams; a number from 0.05 to 5,000 counts only if the label agrees after snapping, other
    numbers are none."""
    named = label_grams(label)["grams"]
    number = value.cast("double")
    direct = snap(F.when(number.between(LEAST_GRAMS, MOST_GRAMS), number))
    return (
        F.when(named.isNull(), F.struct(F.lit(None).cast("double").alias("grams"), F.when(direct.isNull(), F.lit("missing")).otherwise(F.lit("unlabelled")).alias("method")))
        .when(direct.isNull(), F.struct(named.alias("grams"), F.lit("label").alias("method")))
        .when(F.abs(direct - named) <= F.greatest(F.lit(0.02), named * 0.02), F.struct(named.alias("grams"), F.lit("agreed").alias("method")))
        .otherwise(F.struct(F.lit(None).cast("double").alias("grams"), F.lit("conflict").alias("method")))
    )


def stock(state: Column | str) -> Column:
    """struct(in_stock, method): true, false or null; phrases that deny beat those that affirm."""
    text = search_key(state)
    value = F.when((text == "false") | text.rlike(OUT_OF_STOCK), F.lit(False)).when((text == "true") | text.rlike(IN_STOCK), F.lit(True))
    method = F.when(text == "", F.lit("missing")).when(value.isNull(), F.lit("unknown")).otherwise(F.lit("source_state"))
    return F.struct(value.alias("in_stock"), method.alias("method"))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The name of the first pattern that the text holds; rules are (pattern, name)."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def mapped_or_rule(explicit: Column | str, table: dict[str, str], fallback: Column | str, rules: list[tuple[str, str]]) -> Column:
    """struct(value, source): an explicit value by table, else the first rule on the fallback text."""
    key = search_key(explicit)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    guessed = first_rule(search_key(fallback), rules)
    source = F.when(known.isNotNull(), F.lit("explicit")).when(guessed != "unknown", F.lit("text")).otherwise(F.lit("unavailable"))
    return F.struct(F.coalesce(known, guessed).alias("value"), source.alias("source"))


def ordered_tags(flags: list[tuple[str, Column]]) -> Column:
    """The names whose flag is true, in the order given."""
    return F.array_compact(F.array(*(F.when(flag, F.lit(name)) for name, flag in flags)))


def distinct_items(items: Column, most: int = 12, longest: int = 80) -> Column:
    """The first `most` items of an array, the same item (by lower case) once, in order of first appearance."""
    tidy = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= longest))
    keyed = F.array_distinct(F.transform(tidy, lambda x: F.lower(x)))
    return F.slice(F.transform(keyed, lambda k: F.try_element_at(F.filter(tidy, lambda x: F.lower(x) == k), F.lit(1))), 1, most)


# Effects by their patterns, what introduces effects, and what denies one that follows.
EFFECTS = [
    ("Relaxed", r"\b(?:relax(?:ed|ing|ation)|body relaxation)\b"), ("Calm", r"\b(?:calm(?:ing|ed)?|soothing)\b"), ("Uplifted", r"\b(?:uplift(?:ed|ing)|mood elevation)\b"), ("Euphoric", r"\b(?:euphori(?:a|c))\b"),
    ("Energetic", r"\b(?:energetic|energiz(?:e|es|ed|ing)|energy boost|(?:uplifting|invigorating|cerebral) energy)\b"), ("Focused", r"\b(?:focus(?:ed)?|mental focus|concentration)\b"), ("Creative", r"\b(?:creative|creativity)\b"),
    ("Happy", r"\b(?:happy|happiness|cheerful)\b"), ("Social", r"\b(?:social|sociable|talkative)\b"), ("Sleepy", r"\b(?:sleepy|sleepiness|bedtime|sleep support)\b"), ("Sedating", r"\b(?:sedat(?:e|ed|ing|ion)|couch[- ]lock)\b"),
    ("Appetite", r"\b(?:appetite|hungry|hunger|munchies)\b"), ("Mental clarity", r"\b(?:mental clarity|clear[- ]headed)\b"), ("Pain relief", r"\b(?:pain relief|reliev(?:e|es|ed|ing) pain)\b"),
    ("Stress relief", r"\b(?:stress relief|reliev(?:e|es|ed|ing) stress)\b"), ("Tension relief", r"\b(?:tension relief|eas(?:e|es|ed|ing) tension)\b"),
]
EFFECT_CONTEXT = r"(?iU)\b(?:effects?(?:\s+of\s+[^.!?]{0,80})?|experience|delivers?|offers?|provides?|promotes?|supports?|known for|ideal for|great for)\b"
EFFECT_DENIED = r"(?iU)\b(?:without|not|non|no)\s+(?:\w+\s+){0,2}$"
MOST_EFFECTS, BEFORE_CONTEXT, AFTER_CONTEXT, LOOK_BACK = 12, 40, 420, 35


def effects_in(context: Column) -> Column:
    """The effects that a text names and that nothing within LOOK_BACK characters before denies, in the order of EFFECTS."""

    def named(pattern: str) -> Column:
        found = F.when(context.rlike(pattern), spots(context, pattern))
        return F.coalesce(F.exists(found, lambda s: ~cut(context, s["start"] - LOOK_BACK, s["start"]).rlike(EFFECT_DENIED)), F.lit(False))

    return F.slice(ordered_tags([(name, named("(?iU)" + p)) for name, p in EFFECTS]), 1, MOST_EFFECTS)


def effects(df: DataFrame, text: str, name: str = "effects") -> DataFrame:
    """Adds the effects that a text speaks of: those named in the windows around what introduces effects."""
    rows = df.withColumn("__clean", clean_text(text))
    rows = rows.withColumn("__context", F.array_join(around(F.col("__clean"), spots(F.col("__clean"), EFFECT_CONTEXT), BEFORE_CONTEXT, AFTER_CONTEXT), " "))
    return rows.withColumn(name, effects_in(F.col("__context"))).drop("__clean", "__context")


_JOIN, _MARK = r"(?:\s*[|\-–—_:]+\s*|\s+)", r"\s*[|\-–—_:]+\s*"
# What may end a product's name, in the order in which it is taken off, and marketing words.
NAME_ENDINGS = [
    _JOIN + r"tier\s+\d+\s*$", _JOIN + r"(?:smalls|minis|small\s+buds|premium\s+buds|whole\s+flower)\s*$", _JOIN + r"(?:indoor|outdoor|greenhouse|mixed\s+light)\s*$",
    _JOIN + r"(?:limited\s+drop|new\s+drop|best\s+seller|staff\s+pick|exotic|premium|sale)\s*$", _JOIN + r"(?:premium\s+)?(?:high\s+)?thc-?a(?:\s+(?:hemp\s+)?flower)?\s*$", _JOIN + r"(?:hemp\s+)?flower\s*$",
    _MARK + r"(?:0\.5|1|2|3\.5|4|7|14|28|56|112)\s*(?:g|grams?)\s*$|" + _MARK + r"(?:1/8|1/4|1/2|1|2|4)\s*(?:oz|ounces?)?\s*$|" + _MARK + r"(?:eighth|quarter|half\s+ounce|half[- ]?oz|ounce|one\s+ounce|two\s+ounces?|four\s+ounces?|zip)\s*$",
    _MARK + r"(?:premium\s+)?(?:high\s+)?thc-?a\s+(?:hemp\s+)?flower\s*$", r"\s*\((?:indoor|outdoor|greenhouse|mixed\s+light)\)\s*$", _MARK + r"(?:indoor|outdoor|greenhouse|mixed\s+light)\s*$",
    _MARK + r"(?:smalls|minis|small\s+buds|premium\s+buds|whole\s+flower)\s*$", r"\s+thc-?a\s+(?:hemp\s+)?flower\s*$", r"\s+(?:hemp\s+)?flower\s*$", _MARK + r"(?:limited\s+drop|new\s+drop|best\s+seller|staff\s+pick|exotic|premium|sale)\s*$",
]


def _without(name: Column, pattern: str) -> Column:
    """The name without this ending, if a name is left."""
    left = lambda n: F.btrim(F.regexp_replace(n, "(?iU)" + pattern, ""), F.lit(" |-_–—:"))
    return let(name, lambda n: let(left(n), lambda x: F.when(x != "", x).otherwise(n)))


def canonical_names(df: DataFrame, title: str, variant: str, name: str = "name") -> DataFrame:
    """Adds a product's name: its title without the variant's own label at the end, then without NAME_ENDINGS, again and again
    until nothing changes. A name is never emptied. Rounds are at most as many as the title has characters."""
    rows = df.withColumns({"__t": clean_text(title), "__v": clean_text(variant)})
    ends = (F.col("__v") != "") & F.endswith(search_key("__t"), search_key("__v"))
    length = F.length("__t") - F.length("__v")
    # The label as it is written there; a title that ends in it only after folding stays.
    same = ends & (length >= 0) & (F.lower(F.substring("__t", length + 1, F.length("__v"))) == F.lower("__v"))
    own = F.rtrim(F.regexp_replace(F.substring("__t", F.lit(1), length), r"(?:[|\-–—_:]+\s*)?$", ""))
    rows = rows.withColumn("__n", F.when(same, own).otherwise(F.col("__t")))
    begin = F.struct(F.col("__n").alias("n"), F.lit(False).alias("done"))
    step = lambda a, _: F.when(a["done"], a).otherwise(let(reduce(_without, NAME_ENDINGS, a["n"]), lambda m: F.struct(m.alias("n"), (m == a["n"]).alias("done"))))
    fixed = F.aggregate(F.sequence(F.lit(0), F.length("__n")), begin, step, lambda a: a["n"])
    return rows.withColumn(name, F.coalesce(F.nullif(fixed, F.lit("")), F.col("__t"))).drop("__t", "__v", "__n")
