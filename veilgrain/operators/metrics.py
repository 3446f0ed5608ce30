"""Disclosure metrics: conditional rates with explicit denominators, statistics across passes, agreement.

A rate is null where its denominator is zero.  All rates of all groupings come from one aggregate,
combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the independence check and of judge comparison.
IDENTICAL_WARN, DETECT_DROP, LEAST_DETECT_MS = 0.85, 0.5, 200
BINS = 256  # of a key's values; results don't depend on it
RATE_TOLERANCE, RATIO_TOLERANCE, RATIO_SYSTEM_TOLERANCE, RANK_GAP = 0.03, 0.03, 0.05, 0.05


def ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / F.when(den != 0, den))


def rate(hit: Column, among: Column) -> Column:
    """Share of rows with `hit` among the rows with `among`."""
    return ratio(F.count_if(hit & among).cast("double"), F.count_if(among).cast("double"))


def rates() -> dict[str, Column]:
    ok = F.col("status") != "error"
    benign, sensitive = ok & (F.col("category") == "benign"), ok & (F.col("category") != "benign")
    eligible = ok & ((F.col("n_values") > 0) | F.col("has_quasi"))
    canary, quasi, identity = ok & (F.col("canary_count") > 0), ok & F.col("has_quasi"), ok & F.col("has_identity")
    kept = ok & F.col("must_keep_missing").isNotNull() & (F.col("must_keep_total") > 0)

    def total(c: str, among: Column) -> Column:
        return F.coalesce(F.sum(F.when(among, F.col(c))), F.lit(0)).cast("double")

    values, missed, saved = total("n_values", ok), total("n_missed_leaked", ok), total("n_gate_saved", ok)
    return {
        "cases": F.count("*"),
        "errors": F.count_if(~ok),
        "leak_rate": rate(F.col("leaked"), eligible),
        "value_leak_rate": ratio(total("n_values_leaked", ok), values),
        "exact_leak_rate": rate(F.col("exact_leaked"), eligible),
        "canary_leak_rate": rate(F.col("canary_leaked"), canary),
        "quasi_reid_rate": rate(F.col("quasi_reid"), quasi),
        "identity_leak_rate": rate(F.col("identity_leaked"), identity),
        "block_rate": rate(F.col("blocked"), ok),
        "block_rate_sensitive": rate(F.col("blocked"), sensitive),
        "over_block_benign": rate(F.col("blocked"), benign),
        "benign_false_positive_rate": rate(F.col("masking_detections") > 0, benign),
        "over_redaction_rate": ratio(total("must_keep_missing", kept), total("must_keep_total", kept)),
        "over_redaction_case_rate": rate(F.col("must_keep_missing") > 0, kept),
        "detector_miss_rate": ratio(missed + saved, values),
        "gate_save_rate": ratio(saved, saved + missed),
        "gate_save_rate_attributed": ratio(total("n_attributed", ok), saved + missed),
        "overhead_ms_mean": F.avg(F.when(ok, F.col("overhead_ms"))),
        "overhead_ms_p50": F.percentile(F.when(ok, F.col("overhead_ms")), F.lit(0.5)),
        "overhead_ms_p95": F.percentile(F.when(ok, F.col("overhead_ms")), F.lit(0.95)),
        "client_ms_mean": F.avg(F.when(ok, F.col("client_ms"))),
    }


def rounded(columns: dict[str, Column], places: int = 6) -> list[Column]:
    counts = ("cases", "errors")
    return [(c if k in counts else F.round(c, places)).alias(k) for k, c in columns.items()]


def compute_metrics(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(*rounded(rates()))


def metrics_by_groups(scores: DataFrame) -> DataFrame:
    """All three granularities of a pass in one aggregate: overall, by category, by language."""
    sets = scores.groupingSets([["pass"], ["pass", "category"], ["pass", "lang"]], "pass", "category", "lang")
    return sets.agg(*rounded(rates()))


def describe(df: DataFrame, *keys: str, value: str) -> DataFrame:
    """n, mean, sample standard deviation (0 for a single value), least and greatest; nulls are skipped."""
    v = F.col(value)
    n = F.count(v)
    sd = F.when(n == 1, 0.0).otherwise(F.stddev_samp(v))
    return df.groupBy(*keys).agg(n.alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(sd, 6).alias("sd"), F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"))


def across_passes(per_pass: DataFrame, metrics: list[str]) -> DataFrame:
    long = per_pass.select("pass", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("pass", metrics, "metric", "value")
    return describe(long, "metric", value="value")


def case_failures(scores: DataFrame) -> DataFrame:
    """For each case, in how many passes it leaked, was blocked or over-redacted; persistent: it leaked in
    every pass that was evaluated."""
    ok = F.col("status") != "error"
    out = scores.groupBy("case_id").agg(
        F.count("*").alias("passes"),
        F.count_if(~ok).alias("errors"),
        F.count_if(ok & F.col("leaked")).alias("leaked_passes"),
        F.count_if(ok & F.col("has_quasi") & F.col("quasi_reid")).alias("quasi_reid_passes"),
        F.count_if(ok & F.col("blocked")).alias("blocked_passes"),
        F.count_if(ok & (F.col("masking_detections") > 0)).alias("fp_passes"),
        F.count_if(ok & (F.coalesce("must_keep_missing", F.lit(0)) > 0)).alias("over_redaction_passes"),
    )
    evaluated = F.col("passes") - F.col("errors")
    return out.withColumn("evaluated_passes", evaluated).withColumn("persistent", (evaluated > 0) & (F.col("leaked_passes") == evaluated))


def leaks(failures: DataFrame) -> DataFrame:
    """Cases with a leak, ranked by the share of passes."""
    share = F.col("leaked_passes") / F.greatest("evaluated_passes", F.lit(1))
    ranked = failures.where("leaked_passes > 0").withColumn("share", F.round(share, 6))
    return ranked.select("case_id", "leaked_passes", "evaluated_passes", "persistent", "share")


def independence(records: DataFrame, passes: int) -> DataFrame:
    """Share of cases, among those that sent something in all passes, whose payloads are all alike."""
    per = records.where("outbound_hash is not null").groupBy("case_id").agg(F.count("*").alias("sent"), F.count_distinct("outbound_hash").alias("kinds")).where(F.col("sent") == passes)
    return per.agg(F.count("*").alias("cases_compared"), F.count_if(F.col("kinds") == 1).alias("identical_cases"), F.round(rate(F.col("kinds") == 1, F.lit(True)), 6).alias("identical_rate"))


def detect_drop(records: DataFrame) -> DataFrame:
    """Median detection time by pass, and whether it fell below half of the first pass's."""
    medians = records.groupBy("pass").agg(F.median("detect_ms").alias("p50"))
    first = F.first("p50").over(Window.orderBy("pass"))
    warn = (F.col("pass") > F.min("pass").over(Window.orderBy("pass"))) & (first >= LEAST_DETECT_MS) & (F.col("p50") < DETECT_DROP * first)
    return medians.select("pass", F.round("p50", 6).alias("p50"), warn.alias("warned"))


def kappa(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Cohen's kappa of two binary raters; null if chance agreement is certain."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    p = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("observed"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    expected = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    k = F.when(expected < 1, (F.col("observed") - expected) / F.when(expected < 1, 1 - expected))
    return p.select(*keys, "n", F.round("observed", 6).alias("agreement"), F.round(k, 6).alias("kappa"))


def below(counts: DataFrame, value: str, weights: tuple[str, ...], *keys: str) -> DataFrame:
    """`counts` (keys, value, weights), a row for each value of a key, with `<weight>_below`: the sum over the key's
    smaller values.  Values that their hashes choose, the same in any run, part a key into bins, sums of bins add up
    to where a bin starts, and a window only spans a bin, so no task holds a key; the sums are exact wherever the
    cuts fall."""
    own = counts.withColumn("_group", F.struct(*keys) if keys else F.lit(0))
    drawn = own.groupBy("_group", F.pmod(F.xxhash64(value), F.lit(BINS)).alias("_draw")).agg(F.min(F.struct(F.xxhash64(value).alias("h"), F.col(value).alias("v"))).alias("_least"))
    cuts = drawn.groupBy("_group").agg(F.collect_list("_least.v").alias("_cuts"))
    binned = own.join(cuts, "_group").withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    earlier = Window.partitionBy("_group").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_group", "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy("_group", "_bin").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    starts = starts.select("_group", "_bin", *[F.coalesce(F.sum(f"_{w}").over(earlier), F.lit(0)).alias(f"_{w}_start") for w in weights])
    out = binned.join(starts, ["_group", "_bin"])
    sums = {f"{w}_below": F.col(f"_{w}_start") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights}
    return out.withColumns(sums).drop("_group", "_bin", *[f"_{w}_start" for w in weights])


def percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]], *keys: str) -> DataFrame:
    """(keys, a column for each wanted (value, share)): exact percentiles, between two values in proportion, as
    `percentile` has them; from counts of values, where that keeps all of a key's values in one task's map."""
    long = df.unpivot(list(keys), sorted({v for v, _ in wanted.values()}), "_of", "_value").where("_value is not null")
    counts = long.groupBy(*keys, "_of", "_value").agg(F.count("*").alias("_n"))
    placed = below(counts, "_value", ("_n",), *keys, "_of")
    totals = counts.groupBy(F.struct(*keys, "_of").alias("_whole")).agg((F.sum("_n") - 1).alias("_last"))
    placed = placed.withColumn("_whole", F.struct(*keys, "_of")).join(totals, "_whole")
    at = lambda place: F.max(F.when((F.col("_n_below") <= place) & (place < F.col("_n_below") + F.col("_n")), F.col("_value")))
    ends = []
    for name, (value, share) in wanted.items():
        place = F.when(F.col("_of") == value, F.col("_last") * share)
        ends += [at(F.floor(place)).alias(f"_{name}_low"), at(F.ceil(place)).alias(f"_{name}_high"), F.max(place).alias(f"_{name}_place")]
    found = placed.groupBy(*keys).agg(*ends)

    def between(name: str) -> Column:
        low, high, place = (F.col(f"_{name}_{c}") for c in ("low", "high", "place"))
        share = place - F.floor(place)
        return F.when(low == high, low.cast("double")).otherwise((1 - share) * low + share * high)

    return found.select(*keys, *[between(name).alias(name) for name in wanted])


def spearman(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Rank correlation with ties, which share their mean rank; null for constant series or fewer than two rows.  Ranks
    belong to values, so they are worked out on the counts of values and met by the counts of pairs."""
    key = F.struct(*keys) if keys else F.lit(0)
    pairs = df.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n")).withColumn("_key", key)
    for c in ("_a", "_b"):
        ranked = below(pairs.groupBy("_key", c).agg(F.sum("_n").alias("_w")), c, ("_w",), "_key")
        ranked = ranked.select(F.struct("_key", c).alias("_place"), (F.col("_w_below") + (F.col("_w") + 1) / 2).alias(f"{c}_rank"))
        pairs = pairs.withColumn("_place", F.struct("_key", c)).join(ranked, "_place").drop("_place")
    x, y, n = F.col("_a_rank"), F.col("_b_rank"), F.col("_n")
    # Ranks of a key have the mean (count + 1) / 2, so moments are taken around it, as sums over pairs.
    m = pairs.join(pairs.groupBy("_key").agg(F.sum("_n").alias("n")), "_key")
    mean = (F.col("n") + 1) / 2
    m = m.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(n * (x - mean) * (y - mean)).alias("c"), F.sum(n * (x - mean) * (x - mean)).alias("va"), F.sum(n * (y - mean) * (y - mean)).alias("vb"))
    rho = F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("c") / F.sqrt(F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("va") * F.col("vb"))))
    return m.select(*keys, "n", F.round(rho, 6).alias("rho"))


def reversals(systems: DataFrame, gap: float = RANK_GAP) -> DataFrame:
    """Pairs of systems that the reference separates by `gap` and the candidate puts the other way round;
    `systems` has one row for each system: (system, reference, candidate)."""
    s, t = systems.alias("s"), systems.alias("t")
    by_ref, by_cand = F.col("s.reference") - F.col("t.reference"), F.col("s.candidate") - F.col("t.candidate")
    return s.join(t, F.col("s.system") < F.col("t.system")).where((F.abs(by_ref) >= gap) & (by_ref * by_cand < 0)).select(F.col("s.system").alias("first"), F.col("t.system").alias("second"))


def compare_binary(pairs: DataFrame, system: str, reference: str, candidate: str) -> DataFrame:
    """Rates of two judges by system, their difference, and net flips."""
    r, c = F.col(reference).cast("double"), F.col(candidate).cast("double")
    return pairs.groupBy(system).agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("reference"), F.round(F.avg(c), 6).alias("candidate"), F.round(F.avg(c) - F.avg(r), 6).alias("delta"), F.sum(c - r).cast("long").alias("net_flips"))


def qualifies(compared: DataFrame, retest: float = 0.0) -> DataFrame:
    """Whether each system's judgments stay within the tolerance, or within one flip."""
    tolerance = max(RATE_TOLERANCE, abs(retest))
    bad = (F.abs("delta") > tolerance + 1e-9) & (F.abs("net_flips") > 1)
    return compared.withColumn("qualifies", F.col("delta").isNull() | ~bad)


def utility(rows: DataFrame, *keys: str) -> DataFrame:
    """Ratio of mean usefulness (not the mean of ratios), distortion, and similar-or-better share."""
    s, r = F.col("system_score").cast("double"), F.col("reference_score").cast("double")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg(s), 6).alias("usefulness"),
        F.round(ratio(F.avg(s), F.avg(r)), 6).alias("utility_ratio"),
        F.round(rate(F.col("distorted"), F.lit(True)), 6).alias("distortion_rate"),
        F.round(rate(s >= r, F.lit(True)), 6).alias("similar_or_better"),
    )


def attack_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Recovery rates of an attacker; three-valued flags count only where they are known."""
    values = F.sum("n_values").cast("double")
    known = lambda c: rate(F.col(c), F.col(c).isNotNull())
    return rows.groupBy(*keys).agg(
        F.count("*").alias("cases"),
        F.round(ratio(F.sum("n_exact").cast("double"), values), 6).alias("value_recovery_rate"),
        F.round(ratio(F.sum(F.col("n_exact") + F.col("n_partial")).cast("double"), values), 6).alias("value_partial_rate"),
        F.round(rate(F.col("n_exact") > 0, F.col("n_values") > 0), 6).alias("value_case_rate"),
        F.round(known("identity_recovered"), 6).alias("identity_recovery_rate"),
        F.round(known("situation_inferred"), 6).alias("situation_inference_rate"),
        F.round(known("linkable"), 6).alias("linkable_disclosure_rate"),
        F.count_if(F.col("linkable").isNotNull()).alias("linkable_cases"),
    )


def linkable(identity: Column, situation: Column) -> Column:
    """Both known and both true; null if either is unknown."""
    return F.when(identity.isNotNull() & situation.isNotNull(), identity & situation)


def overhead(timings: Column) -> Column:
    """Local milliseconds of a timings map: the total less what remote services took, at least 0; without a
    total, the sum of all that isn't remote.  Null for an empty map."""
    remote = lambda k: F.rlike(k, F.lit("(?i)upstream|tavily|cloud|remote|provider"))
    add = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)
    far, near = add(F.map_filter(timings, lambda k, v: remote(k))), add(F.map_filter(timings, lambda k, v: ~remote(k)))
    total = F.coalesce(F.try_element_at(timings, F.lit("total")), F.try_element_at(timings, F.lit("total_ms")))
    return F.when(F.size(timings) > 0, F.when(total.isNotNull(), F.greatest(total - far, F.lit(0.0))).otherwise(near))


def outcome(leaked: Column, detected: Column, blocked: Column) -> Column:
    return F.when(leaked, F.when(detected, "leaked_despite_detection").otherwise("missed_leaked")).otherwise(F.when(detected, "detected_removed").when(blocked, "gate_saved").otherwise("removed_unattributed"))
