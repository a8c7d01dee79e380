"""Reports: coverage, status roll-up, certification and continuity gates, percentiles, violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(field, populated, missing, ratio): one pass over the rows."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, c) in enumerate(checks)))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), F.col(f"c{i}").alias("populated")) for i, (name, _) in enumerate(checks))))
    ratio = F.when(F.col("n") > 0, F.round((F.col("r.populated").cast("decimal(38,12)") / F.col("n")), 6).cast("double")).otherwise(F.lit(0.0))
    return counts.select("n", rows.alias("r")).select("r.field", "r.populated", (F.col("n") - F.col("r.populated")).alias("missing"), ratio.alias("ratio"))


def gate_rows(df: DataFrame, gates: list[tuple[str, Column, Column]]) -> DataFrame:
    """(gate, measured, passed) of one-row measurements."""
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("gate"), measured.cast("double").alias("measured"), passed.alias("passed")) for name, measured, passed in gates)))
    return df.select(rows.alias("g")).select("g.*")


def violations(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(check, key): the rows that break an invariant; all is well if there are none."""
    out = None
    for name, df, key in checks:
        part = df.select(F.lit(name).alias("check"), key.cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def floor_percentile(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], cuts: int = 256) -> DataFrame:
    """The value at place floor(n * share) of the sorted values (the last at most), exactly.

    Equal values are counted before the shuffle. Approximate percentiles cut each key's values into `cuts` ranges; counts of
    ranges (a few rows a key) tell in which range a place lies, and only that range's values are put in order. So a key
    with most of the rows is spread over many tasks.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    edges = rows.groupBy(*keys).agg(F.percentile_approx("__v", F.array(*(F.lit(i / cuts) for i in range(1, cuts))), F.lit(10_000)).alias("__cuts"))
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c")).join(edges, keys)
    counts = counts.select(*keys, "__v", "__c", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__range"))
    whole = Window.partitionBy(*keys)
    ranges = counts.groupBy(*keys, "__range").agg(F.sum("__c").alias("__n"))
    ranges = ranges.withColumn("__to", F.sum("__n").over(whole.orderBy("__range"))).withColumn("__total", F.sum("__n").over(whole))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("__total") * share), F.col("__total") - 1).alias("place")) for name, share in shares.items())))
    wanted = ranges.select(*keys, "__range", "__to", "__n", wanted.alias("__w")).where((F.col("__w.place") < F.col("__to")) & (F.col("__w.place") >= F.col("__to") - F.col("__n")))
    inner = counts.join(wanted, [*keys, "__range"])
    reached = F.col("__to") - F.col("__n") + F.sum("__c").over(Window.partitionBy(*keys, "__range", "__w.name").orderBy("__v"))
    hits = inner.withColumn("__reached", reached).where(F.col("__reached") > F.col("__w.place"))
    return hits.groupBy(*keys).agg(*(F.min(F.when(F.col("__w.name") == name, F.col("__v"))).alias(name) for name in shares))


def latest_attempts(df: DataFrame, keys: list[str], order: list[Column], ok: Column) -> DataFrame:
    """Of each key how many attempts there were, and the last one's outcome."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(F.count("*").alias("attempts"), F.max_by(ok, rank).alias("recovered"), F.count_if(~ok).alias("failures"))


def certification(df: DataFrame) -> DataFrame:
    """(gate, measured, passed) of one row of measurements: how many known positives, negatives and ambiguous cases there are and
    were judged rightly, identity_overlap and duplicate_rate in percent, the regressions of coverage in points, and whether
    replay, evidence and routes hold; shadow_passed only where it is not null. Without cases a rate is 0."""
    share = lambda part, whole: F.coalesce(F.round(F.try_divide(F.col(part).cast("decimal(20,6)") * 100, F.col(whole)), 3), F.lit(0)).cast("double")
    exact = lambda part, whole, least: (F.col(whole) > 0) & (F.col(part) * 100 >= F.col(whole) * least)
    flag = lambda c: (F.coalesce(F.col(c), F.lit(False)).cast("int"), F.coalesce(F.col(c), F.lit(False)))
    number = lambda c, test: (F.col(c), F.coalesce(test(F.col(c)), F.lit(False)))
    gates = {
        "evidence_integrity": flag("evidence_integrity"), "source_route_match": flag("source_route_match"),
        **{f"{k}_evidence_present": number(f"{k}_total", lambda c: c > 0) for k in ("positive", "negative", "ambiguous")},
        "known_positive_recall": (share("positive_accepted", "positive_total"), exact("positive_accepted", "positive_total", 98)),
        "known_negative_precision": (share("negative_rejected", "negative_total"), exact("negative_rejected", "negative_total", 100)),
        "ambiguous_fail_closed": (share("ambiguous_closed", "ambiguous_total"), exact("ambiguous_closed", "ambiguous_total", 100)),
        "identity_continuity": number("identity_overlap", lambda c: c >= 98), "duplicate_rate": number("duplicate_rate", lambda c: c < 1),
        "required_field_coverage": number("required_regression", lambda c: c >= 0), "optional_field_coverage": number("optional_regression", lambda c: c >= -2), "replay_deterministic": flag("replay_deterministic"),
        "shadow_live": flag("shadow_passed"),
    }
    rows = gate_rows(df.select("*"), [(name, m, p) for name, (m, p) in gates.items() if name != "shadow_live"])
    return rows.unionByName(gate_rows(df.where("shadow_passed IS NOT NULL"), [("shadow_live", *gates["shadow_live"])]))
