"""Scores of cases from their records: which protected values left the machine, in which writing, and why not.

Everything joins on the case: payloads meet only their own case's values, so no text meets all values."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilgrain.operators import gate, metrics, quasi, scan

RECORD = ("case_id", "pass")
NOT_MASKING = ("keep", "allow", "none", "pass", "")  # fixed values: actions that leave a value as it is


@F.pandas_udf(StringType())
def nfkc(value: pd.Series) -> pd.Series:
    """The compatibility form, trimmed."""
    return value.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip())


def hash_candidates(value: Column, key: bytes | None = None) -> Column:
    """Hashes under which a value may be on record: of its text as given, trimmed, and in NFKC, plain and keyed."""
    forms = F.array_distinct(F.filter(F.array(value, F.trim(value), nfkc(value)), lambda v: v != ""))
    plain = F.transform(forms, lambda v: F.sha2(v, 256))
    return F.concat(plain, F.transform(forms, lambda v: gate.hmac_sha256(v, key))) if key else plain


def found(outbound: DataFrame, needles: DataFrame) -> DataFrame:
    """(case_id, pass, destination, value, variant, kept): the strictest variant of each case's `needles` (case_id,
    value) in each of its payloads, `outbound` being (case_id, pass, destination, payload).  A payload that is JSON
    is searched leaf by leaf, unescaped; what is only found in a decoded layer says so in its variant.  A
    payload travels once with all values of its case."""
    wanted = needles.groupBy("case_id").agg(F.collect_set("value").alias("values"))
    return scan.scanned_values(outbound.join(wanted, "case_id"), *RECORD, "destination")


def value_outcomes(values: DataFrame, hits: DataFrame, detections: DataFrame, records: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row for each record and value: leaked, exact, detected, attributed and outcome.

    values: (case_id, value, is_canary, is_identity); detections: (case_id, pass, text_sha256); records: (case_id, pass,
    status, gate_decision, reasons, block_reasons).  A detection counts if it recorded one of the value's hashes; the
    reasons of the gate, or of the block, if one holds the first twelve digits of such a hash."""
    leaked = hits.groupBy(*RECORD, "value").agg(F.lit(True).alias("leaked"), F.bool_or(F.col("variant") == "exact").alias("exact"))
    values = values.withColumn("_hashes", hash_candidates(F.col("value"), key))
    hashed = values.select("case_id", "value", F.explode("_hashes").alias("text_sha256"))
    detected = detections.select(*RECORD, "text_sha256").distinct().join(hashed, ["case_id", "text_sha256"]).select(*RECORD, "value", F.lit(True).alias("detected")).distinct()
    none = F.array().cast("array<string>")
    said = F.array_join(F.concat(*[F.coalesce(c, none) for c in ("reasons", "block_reasons") if c in records.columns]), " ")
    rows = records.join(values, "case_id").join(leaked, [*RECORD, "value"], "left").join(detected, [*RECORD, "value"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("leaked", "exact", "detected")})
    rows = rows.withColumn("attributed", F.exists("_hashes", lambda h: F.contains(said, F.substring(h, 1, 12)))).drop("_hashes")
    blocked = (F.col("status") == "blocked") | F.coalesce(F.col("gate_decision") == "block", F.lit(False))
    return rows.withColumn("outcome", metrics.outcome(F.col("leaked"), F.col("detected"), blocked))


def score_cases(records: DataFrame, values: DataFrame, outbound: DataFrame, detections: DataFrame, attributes: DataFrame, keeps: DataFrame, key: bytes | None = None) -> DataFrame:
    """One score row for each record, in the columns that `metrics` works on.

    attributes: (case_id, attribute, value, is_identity, k), a row for each surface form of a quasi-identifier;
    keeps: (case_id, value) that should reach the destination, of which only lenient writings in undecoded
    payloads count.  What was never sent can't be missing: must_keep_missing is null without payloads.  A record of
    an error has no scores: they are null."""
    needles = reduce(DataFrame.union, [x.select("case_id", "value") for x in (values, attributes, keeps)])
    hits = found(outbound, needles)
    per_value = value_outcomes(values, hits, detections, records, key)
    count = lambda c: F.count_if(c).alias
    of_values = per_value.groupBy(*RECORD).agg(
        F.count("*").alias("n_values"),
        count(F.col("leaked"))("n_values_leaked"),
        F.bool_or("exact").alias("exact_leaked"),
        count(F.col("is_canary"))("canary_count"),
        F.bool_or(F.col("is_canary") & F.col("leaked")).alias("canary_leaked"),
        F.bool_or("is_identity").alias("_has_value"),
        F.bool_or(F.col("is_identity") & F.col("leaked")).alias("_value_leaked"),
        count(F.col("outcome") == "missed_leaked")("n_missed_leaked"),
        count(F.col("outcome") == "gate_saved")("n_gate_saved"),
        count((F.col("outcome") == "gate_saved") & F.col("attributed"))("n_attributed"),
    )
    size = attributes.groupBy("case_id").agg(F.count_distinct("attribute").alias("_size"), F.count_distinct(F.when(F.col("is_identity"), F.col("attribute"))).alias("_identity"), F.max("k").alias("k"))
    size = size.withColumn("_identity_k", quasi.case_k(F.coalesce("k", "_size"), F.col("_size") - F.col("_identity")))
    met = hits.join(attributes.select("case_id", "value", "attribute", "is_identity"), ["case_id", "value"])
    per_place = met.groupBy(*RECORD, "destination").agg(F.count_distinct("attribute").alias("n"), F.count_distinct(F.when(F.col("is_identity"), F.col("attribute"))).alias("n_identity"))
    of_quasi = per_place.groupBy(*RECORD).agg(F.max("n").alias("_found"), F.max("n_identity").alias("_found_identity"))
    kept = keeps.groupBy("case_id").agg(F.count_distinct("value").alias("must_keep_total"))
    there = hits.where("kept").join(keeps.distinct(), ["case_id", "value"]).groupBy(*RECORD).agg(F.count_distinct("value").alias("_kept"))
    sent = outbound.groupBy(*RECORD).agg(F.count("*").alias("n_outbound"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "destination", "payload"))), "\n"), 256).alias("outbound_hash"))
    masking = detections.where(~F.lower(F.coalesce("action", F.lit("none"))).isin(*NOT_MASKING)).groupBy(*RECORD).agg(F.count("*").alias("masking_detections"))
    out = records.join(of_values, [*RECORD], "left").join(size, "case_id", "left").join(of_quasi, [*RECORD], "left").join(kept, "case_id", "left")
    out = out.join(there, [*RECORD], "left").join(sent, [*RECORD], "left").join(masking, [*RECORD], "left")
    zero, no = ("n_values", "n_values_leaked", "canary_count", "n_missed_leaked", "n_gate_saved", "n_attributed", "_found", "_found_identity", "must_keep_total", "_kept", "masking_detections"), ("exact_leaked", "canary_leaked", "_has_value", "_value_leaked")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero} | {c: F.coalesce(c, F.lit(False)) for c in no})
    has_quasi, reid = F.col("_size").isNotNull(), F.coalesce(F.col("_found") >= F.coalesce("k", "_size"), F.lit(False))
    enough = F.coalesce(F.col("_identity") >= F.col("_identity_k"), F.lit(False))
    out = out.withColumns(
        {
            "blocked": (F.col("status") == "blocked") | F.coalesce(F.col("gate_decision") == "block", F.lit(False)),
            "has_quasi": has_quasi,
            "quasi_reid": reid,
            "leaked": (F.col("n_values_leaked") > 0) | reid,
            "has_identity": F.col("_has_value") | enough,
            "identity_leaked": F.col("_value_leaked") | F.coalesce(F.col("_found_identity") >= F.col("_identity_k"), F.lit(False)),
            "must_keep_missing": F.when(F.col("n_outbound").isNotNull(), F.col("must_keep_total") - F.col("_kept")),
        }
    )
    scores = ("n_values", "n_values_leaked", "exact_leaked", "canary_count", "canary_leaked", "n_missed_leaked", "n_gate_saved", "n_attributed", "blocked", "has_quasi", "quasi_reid", "leaked", "has_identity", "identity_leaked", "must_keep_total", "must_keep_missing", "masking_detections", "outbound_hash")
    out = out.withColumns({c: F.when(F.col("status") != "error", F.col(c)) for c in scores})
    return out.drop("block_reasons", "_has_value", "_value_leaked", "_size", "_identity", "k", "_identity_k", "_found", "_found_identity", "_kept", "n_outbound", "reasons", "gate_decision")


def attribute_match(forms: Column, guesses: Column) -> Column:
    """exact if a guess holds a surface form; partial if it has all of a form's numbers, or of a form without any
    half of its words; else null.  Both are arrays of strings."""
    words = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.rlike(w, F.lit(r"^\p{N}+$")) | (F.length(w) >= F.when(F.rlike(w, F.lit(r"^\p{ASCII}+$")), 3).otherwise(2))))
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))
    known, known_numbers = F.flatten(F.transform(guesses, words)), F.flatten(F.transform(guesses, numbers))
    exact = F.exists(forms, lambda f: F.exists(guesses, lambda g: scan.ascii_variant(g, f).isNotNull()))

    def partly(f: Column) -> Column:
        own = F.filter(words(f), lambda w: ~F.rlike(w, F.lit(r"^\p{N}+$")))
        return F.when(F.size(numbers(f)) > 0, F.size(F.array_except(numbers(f), known_numbers)) == 0).otherwise((F.size(own) > 0) & (F.size(F.array_intersect(own, known)) * 2 >= F.size(own)))

    return F.when(exact, "exact").when(F.exists(forms, partly), "partial")


def observer_views(hops: DataFrame) -> DataFrame:
    """(run_id, view, content): what an observer of all hops or of searches alone sees of a run; a message that
    later hops repeat counts once.  hops: (run_id, hop_no, destination, content)."""
    upstream = hops.where("destination = 'upstream'").dropDuplicates(["run_id", "content"]).select("run_id", "content")
    searches = hops.where("destination = 'search'").select("run_id", "content")
    whole = upstream.union(searches).select("run_id", F.lit("all").alias("view"), "content")
    return whole.union(searches.select("run_id", F.lit("search").alias("view"), "content"))


def mode_metrics(runs: DataFrame, *keys: str) -> DataFrame:
    """Rates pooled over the runs of a mode: sums over sums, not means of rates."""
    s = lambda c: F.sum(c).cast("double")
    n, ratio = F.count("*").cast("double"), metrics.ratio
    found = {
        "runs": F.count("*"),
        "finished_rate": ratio(F.count_if(F.col("status") == "finished").cast("double"), n),
        "fact_recovery": ratio(s("facts_exact"), s("facts_n")),
        "fact_recovery_partial": ratio(s("facts_partial"), s("facts_n")),
        "situation_inference": ratio(F.count_if("situation").cast("double"), n),
        "search_only_fact_recovery": ratio(s("search_exact"), s("facts_n")),
        "utility_mean": F.avg("utility"),
        "searches_per_run": ratio(s("searches"), n),
        "search_sent_rate": ratio(s(F.col("searches") - F.col("search_blocked")), s("searches")),
        "search_blocked_rate": ratio(s("search_blocked"), s("searches")),
        "steps_mean": ratio(s("steps"), n),
        "latency_s_p50": F.median("latency_s"),
    }
    return runs.groupBy(*keys).agg(*[(c if k == "runs" else F.round(c, 6)).alias(k) for k, c in found.items()])


def estimated_tokens(text: Column) -> Column:
    """About four ASCII characters a token, and one token for any other character."""
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (F.ceil(ascii_chars / 4) + F.length(text) - ascii_chars).cast("long")
