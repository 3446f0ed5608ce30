"""Queries of the analytics half, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.session import table
from veilgrain.operators import limits, metrics, quasi, sampling, spans
from veilgrain.plans.fixtures import ATTACKS, CASE_SCORES, JUDGED, SPANS, as_sql, rows

Spark, Frame = SparkSession, DataFrame


def case_scores(spark: Spark, d: str) -> Frame:
    return rows(spark, d, CASE_SCORES, "orders")


def pass_metrics(spark: Spark, d: str) -> Frame:
    return metrics.compute_metrics(case_scores(spark, d), "pass")


def metrics_by_groups(spark: Spark, d: str) -> Frame:
    return metrics.metrics_by_groups(case_scores(spark, d))


ACROSS = ["leak_rate", "value_leak_rate", "block_rate", "over_redaction_rate", "overhead_ms_p95"]


def metrics_across_passes(spark: Spark, d: str) -> Frame:
    return metrics.across_passes(metrics.compute_metrics(case_scores(spark, d), "pass"), ACROSS)


def describe_latency(spark: Spark, d: str) -> Frame:
    return metrics.describe(case_scores(spark, d), "category", "lang", value="overhead_ms")


def latency_percentiles(spark: Spark, d: str) -> Frame:
    price = F.col("l_extendedprice")
    li = table(spark, d, "lineitem").select("l_linestatus", price.alias("price"), F.when(F.col("l_returnflag") == "R", price).alias("called"))
    wanted = {"p50": ("price", 0.5), "p95": ("price", 0.95), "p50_called": ("called", 0.5), "p95_called": ("called", 0.95)}
    n = li.groupBy(F.struct("l_linestatus").alias("_key")).agg(F.count("*").alias("n"), F.count("called").alias("n_called"))
    own = metrics.percentiles(li, wanted, "l_linestatus").withColumn("_key", F.struct("l_linestatus"))
    out = n.join(own, "_key", "left")
    return out.select("_key.l_linestatus", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n_called", F.round("p50_called", 6).alias("p50_called"), F.round("p95_called", 6).alias("p95_called"))


def case_failures(spark: Spark, d: str) -> Frame:
    return metrics.case_failures(case_scores(spark, d))


def leak_list(spark: Spark, d: str) -> Frame:
    return metrics.leaks(metrics.case_failures(case_scores(spark, d)))


def leak_histogram(spark: Spark, d: str) -> Frame:
    return metrics.case_failures(case_scores(spark, d)).where("leaked_passes > 0").groupBy("leaked_passes").agg(F.count("*").alias("cases"))


def independence_check(spark: Spark, d: str) -> Frame:
    one = case_scores(spark, d).groupBy("case_id", "pass").agg(F.min("outbound_hash").alias("outbound_hash"))
    return metrics.independence(one, 3)


def detect_drop(spark: Spark, d: str) -> Frame:
    return metrics.detect_drop(case_scores(spark, d))


def judge_kappa(spark: Spark, d: str) -> Frame:
    return metrics.kappa(rows(spark, d, JUDGED, "lineitem"), "judge_a", "judge_b", "system")


def label_kappa(spark: Spark, d: str) -> Frame:
    return metrics.kappa(table(spark, d, "labels").withColumn("bad", 1 - F.col("quality")), "bad", "toxic")


def judge_spearman(spark: Spark, d: str) -> Frame:
    return metrics.spearman(rows(spark, d, JUDGED, "lineitem"), "system_score", "reference_score", "system")


def judge_agreement(spark: Spark, d: str) -> Frame:
    diff = F.abs(F.col("system_score") - F.col("reference_score"))
    return rows(spark, d, JUDGED, "lineitem").groupBy("system").agg(F.round(F.avg(diff), 6).alias("mean_abs_diff"), F.round(F.avg((diff == 0).cast("double")), 6).alias("agreement"))


def judge_compare(spark: Spark, d: str) -> Frame:
    return metrics.qualifies(metrics.compare_binary(rows(spark, d, JUDGED, "lineitem"), "system", "judge_a", "judge_b"))


def ranking_reversals(spark: Spark, d: str) -> Frame:
    systems = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("system")).agg(F.round(F.avg("c_acctbal") / 1000, 6).alias("reference"), F.round(F.avg(F.length("c_mktsegment").cast("double")), 6).alias("candidate"))
    return metrics.reversals(systems)


def utility_metrics(spark: Spark, d: str) -> Frame:
    return metrics.utility(rows(spark, d, JUDGED, "lineitem"), "system")


def attack_metrics(spark: Spark, d: str) -> Frame:
    df = rows(spark, d, ATTACKS, "lineitem")
    return metrics.attack_metrics(df.withColumn("linkable", metrics.linkable(F.col("identity_recovered"), F.col("situation_inferred"))), "lang")


def value_outcomes(spark: Spark, d: str) -> Frame:
    li = table(spark, d, "lineitem")
    o = metrics.outcome(F.col("l_returnflag") == "R", F.col("l_linenumber") % 2 == 0, F.col("l_linestatus") == "F")
    return li.groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


def overhead_ms(spark: Spark, d: str) -> Frame:
    o = table(spark, d, "orders")
    total = F.when(F.col("o_orderkey") % 3 == 0, F.map_from_arrays(F.array(F.lit("total")), F.array(F.col("o_totalprice")))).otherwise(F.create_map().cast("map<string,double>"))
    timings = F.map_concat(F.create_map(F.lit("detect"), F.col("o_totalprice") / 10, F.lit("upstream_ms"), F.col("o_totalprice") / 4), total)
    return o.select("o_orderkey", F.round(metrics.overhead(timings), 4).alias("overhead_ms"))


def resolve_overlaps(spark: Spark, d: str) -> Frame:
    return spans.resolve(rows(spark, d, SPANS, "lineitem")).select("slot_id", "start", "end", "type", "action", "source", "span_no")


def protection_policy(spark: Spark, d: str) -> Frame:
    s = rows(spark, d, SPANS, "lineitem")
    both = spans.with_policy(s, "minimal").withColumn("level", F.lit("minimal")).unionByName(spans.with_policy(s, "strict").withColumn("level", F.lit("strict")))
    return both.groupBy("level", "source", "type", "action").agg(F.count("*").alias("n"))


def span_agreement(spark: Spark, d: str) -> Frame:
    s = rows(spark, d, SPANS, "lineitem")
    met = spans.agreement(s.where("source = 'llm'"), s.where("source = 'gliner'"))
    return met.select(F.col("x.slot_id").alias("slot_id"), F.col("x.span_no").alias("a"), F.col("y.span_no").alias("b"), "shared", "agrees")


def span_confidence(spark: Spark, d: str) -> Frame:
    s = rows(spark, d, SPANS, "lineitem").withColumn("rule", F.when(F.col("span_no") == 1, "jwt").otherwise("other"))
    out = spans.confidence(s.select("slot_id", "start", "end", "source", "rule", "span_no"), ["jwt"])
    return out.select("slot_id", "span_no", F.array_join("sources", ",").alias("sources"), "confidence")


def merged_intervals(spark: Spark, d: str) -> Frame:
    return spans.covered(rows(spark, d, SPANS, "lineitem").select("slot_id", "start", "end"))


def first_detections(spark: Spark, d: str) -> Frame:
    return spans.first_seen(rows(spark, d, SPANS, "lineitem"), ["slot_id", "type", "action"], ["span_no"]).select("slot_id", "type", "action", "span_no")


def quasi_score(spark: Spark, d: str) -> Frame:
    kinds = F.element_at(F.array(*map(F.lit, quasi.ORDER)), (F.col("l_partkey") % 7 + 1).cast("int"))
    return quasi.scores(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slot_id"), kinds.alias("category")), "slot_id")


def quasi_max_found(spark: Spark, d: str) -> Frame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 3).alias("destination"), (F.col("l_partkey") % 4).alias("attribute"))
    return quasi.max_found(li, "case_id").withColumn("reidentified", F.col("max_found") >= 2)


def allocation(spark: Spark, d: str) -> Frame:
    sizes = table(spark, d, "customer").groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("stratum")).agg(F.count("*").alias("size"))
    return sampling.allocate(sizes, 60)


def stratified_sample(spark: Spark, d: str) -> Frame:
    return sampling.stratified(table(spark, d, "customer"), F.col("c_mktsegment"), "c_custkey", 100, "7").select("stratum", "c_custkey")


def dev_test_split(spark: Spark, d: str) -> Frame:
    return sampling.split(table(spark, d, "customer"), F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")), "c_custkey", 0.3, "11").select("c_custkey", "stratum", "part")


def sliding_limiter(spark: Spark, d: str) -> Frame:
    return limits.recent(table(spark, d, "events"), "user_id", "ts", 86400).select("event_id", "user_id", "recent")


def limiter_replay(spark: Spark, d: str) -> Frame:
    out = limits.admitted(table(spark, d, "events"), "user_id", "ts", 2, 43200, "event_id")
    return out.select("user_id", "event_id", "admitted", F.round("retry_after", 3).alias("retry_after"))


def daily_budget(spark: Spark, d: str) -> Frame:
    out = limits.spent(table(spark, d, "events"), "ts", "value", 50.0, "event_id", "user_id")
    return out.select("event_id", F.round("spent", 4).alias("spent"), "within")


def latest_audit(spark: Spark, d: str) -> Frame:
    from veilgrain.operators.gate import latest

    return latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts").select("user_id", "event_id", "event_type")


def recent_audit(spark: Spark, d: str) -> Frame:
    """The 50 latest records: a listing, so its limit is the feature."""
    return table(spark, d, "events").orderBy(F.col("ts").desc(), "event_id").limit(50).select("event_id", "user_id")


def model_shares(spark: Spark, d: str) -> Frame:
    """Shares by event type, pivoted by day of week."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(metrics.rate(F.col("value") > 50, F.lit(True)), 6).alias("high_share"), F.count_distinct("user_id").alias("users"))


def reuse_rows(spark: Spark, d: str) -> Frame:
    """Judged rows are reused where the payload's hash is known, else fresh."""
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 = 0").groupBy(F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256).alias("h")).agg(F.max("o_totalprice").alias("old_score"))
    new = o.select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256).alias("h"), "o_totalprice")
    return new.join(old, "h", "left").select("o_orderkey", F.coalesce("old_score", "o_totalprice").alias("score"), F.col("old_score").isNotNull().alias("reused"))


QUERIES = (
    pass_metrics, metrics_by_groups, metrics_across_passes, describe_latency, latency_percentiles, case_failures, leak_list, leak_histogram, independence_check, detect_drop, judge_kappa, label_kappa,
    judge_spearman, judge_agreement, judge_compare, ranking_reversals, utility_metrics, attack_metrics, value_outcomes, overhead_ms, resolve_overlaps, protection_policy, span_agreement, span_confidence,
    merged_intervals, first_detections, quasi_score, quasi_max_found, allocation, stratified_sample, dev_test_split, sliding_limiter, limiter_replay, daily_budget, latest_audit, recent_audit, model_shares, reuse_rows,
)

_SCORES, _ATTACKS, _JUDGED, _SPANS = as_sql(CASE_SCORES, "orders"), as_sql(ATTACKS, "lineitem"), as_sql(JUDGED, "lineitem"), as_sql(SPANS, "lineitem")


def _share(hit: str, among: str) -> str:
    return f"round(count(*) FILTER (WHERE ({hit}) AND ({among})) / nullif(count(*) FILTER (WHERE {among}), 0)::DOUBLE, 6)"


def _quotient(num: str, den: str, ok: str = "status <> 'error'") -> str:
    return f"round(coalesce(sum({num}) FILTER (WHERE {ok}), 0)::DOUBLE / nullif(coalesce(sum({den}) FILTER (WHERE {ok}), 0), 0)::DOUBLE, 6)"


_OK = "status <> 'error'"
_KEPT = f"{_OK} AND must_keep_missing IS NOT NULL AND must_keep_total > 0"
_ELIGIBLE = f"{_OK} AND (n_values > 0 OR has_quasi)"
_RATES = f"""count(*) AS cases, count(*) FILTER (WHERE status = 'error') AS errors,
  {_share("leaked", _ELIGIBLE)} AS leak_rate, {_quotient("n_values_leaked", "n_values")} AS value_leak_rate,
  {_share("exact_leaked", _ELIGIBLE)} AS exact_leak_rate, {_share("canary_leaked", _OK + " AND canary_count > 0")} AS canary_leak_rate,
  {_share("quasi_reid", _OK + " AND has_quasi")} AS quasi_reid_rate, {_share("identity_leaked", _OK + " AND has_identity")} AS identity_leak_rate,
  {_share("blocked", _OK)} AS block_rate, {_share("blocked", _OK + " AND category <> 'benign'")} AS block_rate_sensitive,
  {_share("blocked", _OK + " AND category = 'benign'")} AS over_block_benign,
  {_share("masking_detections > 0", _OK + " AND category = 'benign'")} AS benign_false_positive_rate,
  {_quotient("must_keep_missing", "must_keep_total", _KEPT)} AS over_redaction_rate, {_share("must_keep_missing > 0", _KEPT)} AS over_redaction_case_rate,
  {_quotient("n_missed_leaked + n_gate_saved", "n_values")} AS detector_miss_rate, {_quotient("n_gate_saved", "n_gate_saved + n_missed_leaked")} AS gate_save_rate,
  {_quotient("n_attributed", "n_gate_saved + n_missed_leaked")} AS gate_save_rate_attributed,
  round(avg(overhead_ms) FILTER (WHERE {_OK}), 6) AS overhead_ms_mean,
  round(quantile_cont(overhead_ms, 0.5) FILTER (WHERE {_OK}), 6) AS overhead_ms_p50, round(quantile_cont(overhead_ms, 0.95) FILTER (WHERE {_OK}), 6) AS overhead_ms_p95,
  round(avg(client_ms) FILTER (WHERE {_OK}), 6) AS client_ms_mean"""
_FAILURES = f"""SELECT *, passes - errors AS evaluated_passes, (passes - errors > 0 AND leaked_passes = passes - errors) AS persistent FROM (
  SELECT case_id, count(*) AS passes, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE {_OK} AND leaked) AS leaked_passes,
  count(*) FILTER (WHERE {_OK} AND has_quasi AND quasi_reid) AS quasi_reid_passes, count(*) FILTER (WHERE {_OK} AND blocked) AS blocked_passes,
  count(*) FILTER (WHERE {_OK} AND masking_detections > 0) AS fp_passes, count(*) FILTER (WHERE {_OK} AND coalesce(must_keep_missing, 0) > 0) AS over_redaction_passes
  FROM ({_SCORES}) GROUP BY case_id)"""
_DESCRIBE = "count({v}) AS n, round(avg({v}), 6) AS mean, round(CASE WHEN count({v}) = 1 THEN 0.0 ELSE stddev_samp({v}) END, 6) AS sd, round(min({v}), 6) AS low, round(max({v}), 6) AS high"
_PRIO = "list_position(['vault','user','regex','entropy','rule','llm','gliner'], source)"
_KAPPA = """SELECT {keys} n, round(o, 6) AS agreement, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN (o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa
  FROM (SELECT {keys} count(*) AS n, avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END)::DOUBLE AS o, avg({a}::INT)::DOUBLE AS pa, avg({b}::INT)::DOUBLE AS pb FROM {frm} {group})"""
_STRATUM = "c_mktsegment || '/' || c_nationkey"

SQL = {
    "pass_metrics": f"SELECT pass, {_RATES} FROM ({_SCORES}) GROUP BY pass",
    "metrics_by_groups": f"SELECT pass, category, lang, {_RATES} FROM ({_SCORES}) GROUP BY GROUPING SETS ((pass), (pass, category), (pass, lang))",
    "metrics_across_passes": f"SELECT metric, {_DESCRIBE.format(v='value')} FROM (UNPIVOT (SELECT pass, {', '.join(f'{m}::DOUBLE AS {m}' for m in ACROSS)} FROM (SELECT pass, {_RATES} FROM ({_SCORES}) GROUP BY pass)) ON {', '.join(ACROSS)} INTO NAME metric VALUE value) GROUP BY metric",
    "describe_latency": f"SELECT category, lang, {_DESCRIBE.format(v='overhead_ms')} FROM ({_SCORES}) GROUP BY category, lang",
    "latency_percentiles": "SELECT l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, count(*) FILTER (WHERE l_returnflag = 'R') AS n_called, round(quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_returnflag = 'R'), 6) AS p50_called, round(quantile_cont(l_extendedprice, 0.95) FILTER (WHERE l_returnflag = 'R'), 6) AS p95_called FROM lineitem GROUP BY l_linestatus",
    "case_failures": _FAILURES,
    "leak_list": f"SELECT case_id, leaked_passes, evaluated_passes, persistent, round(leaked_passes / greatest(evaluated_passes, 1)::DOUBLE, 6) AS share FROM ({_FAILURES}) WHERE leaked_passes > 0",
    "leak_histogram": f"SELECT leaked_passes, count(*) AS cases FROM ({_FAILURES}) WHERE leaked_passes > 0 GROUP BY leaked_passes",
    "independence_check": f"SELECT count(*) AS cases_compared, count(*) FILTER (WHERE kinds = 1) AS identical_cases, round(count(*) FILTER (WHERE kinds = 1) / nullif(count(*), 0)::DOUBLE, 6) AS identical_rate FROM (SELECT case_id, count(*) AS sent, count(DISTINCT outbound_hash) AS kinds FROM (SELECT case_id, pass, min(outbound_hash) AS outbound_hash FROM ({_SCORES}) GROUP BY case_id, pass) WHERE outbound_hash IS NOT NULL GROUP BY case_id HAVING count(*) = 3)",
    "detect_drop": f"SELECT pass, round(p50, 6) AS p50, (pass > (min(pass) OVER ()) AND first_value(p50) OVER (ORDER BY pass) >= 200 AND p50 < 0.5 * first_value(p50) OVER (ORDER BY pass)) AS warned FROM (SELECT pass, median(detect_ms) AS p50 FROM ({_SCORES}) GROUP BY pass)",
    "judge_kappa": _KAPPA.format(keys="system,", a="judge_a", b="judge_b", frm=f"({_JUDGED})", group="GROUP BY system"),
    "label_kappa": _KAPPA.format(keys="", a="(1 - quality)", b="toxic", frm="labels", group=""),
    "judge_spearman": f"SELECT system, count(*) AS n, round(CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)) END, 6) AS rho FROM (SELECT system, rank() OVER (PARTITION BY system ORDER BY system_score) + (count(*) OVER (PARTITION BY system, system_score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY system ORDER BY reference_score) + (count(*) OVER (PARTITION BY system, reference_score) - 1) / 2.0 AS rb FROM ({_JUDGED})) GROUP BY system",
    "judge_agreement": f"SELECT system, round(avg(abs(system_score - reference_score)), 6) AS mean_abs_diff, round(avg((system_score = reference_score)::INT), 6) AS agreement FROM ({_JUDGED}) GROUP BY system",
    "judge_compare": f"SELECT *, (delta IS NULL OR NOT (abs(delta) > 0.03 + 1e-9 AND abs(net_flips) > 1)) AS qualifies FROM (SELECT system, count(*) AS n, round(avg(judge_a::INT), 6) AS reference, round(avg(judge_b::INT), 6) AS candidate, round(avg(judge_b::INT) - avg(judge_a::INT), 6) AS delta, sum(judge_b::INT - judge_a::INT)::BIGINT AS net_flips FROM ({_JUDGED}) GROUP BY system)",
    "ranking_reversals": "WITH s AS (SELECT c_nationkey AS system, round(avg(c_acctbal) / 1000, 6) AS reference, round(avg(length(c_mktsegment)), 6) AS candidate FROM customer GROUP BY 1) SELECT a.system AS first, b.system AS second FROM s a JOIN s b ON a.system < b.system WHERE abs(a.reference - b.reference) >= 0.05 AND (a.reference - b.reference) * (a.candidate - b.candidate) < 0",
    "utility_metrics": f"SELECT system, count(*) AS n, round(avg(system_score), 6) AS usefulness, round(avg(system_score) / nullif(avg(reference_score), 0), 6) AS utility_ratio, round(avg(distorted::INT), 6) AS distortion_rate, round(avg((system_score >= reference_score)::INT), 6) AS similar_or_better FROM ({_JUDGED}) GROUP BY system",
    "attack_metrics": f"SELECT lang, count(*) AS cases, round(sum(n_exact)::DOUBLE / nullif(sum(n_values), 0)::DOUBLE, 6) AS value_recovery_rate, round(sum(n_exact + n_partial)::DOUBLE / nullif(sum(n_values), 0)::DOUBLE, 6) AS value_partial_rate, {_share('n_exact > 0', 'n_values > 0')} AS value_case_rate, {_share('identity_recovered', 'identity_recovered IS NOT NULL')} AS identity_recovery_rate, {_share('situation_inferred', 'situation_inferred IS NOT NULL')} AS situation_inference_rate, {_share('identity_recovered AND situation_inferred', 'identity_recovered IS NOT NULL AND situation_inferred IS NOT NULL')} AS linkable_disclosure_rate, count(*) FILTER (WHERE identity_recovered IS NOT NULL AND situation_inferred IS NOT NULL) AS linkable_cases FROM ({_ATTACKS}) GROUP BY lang",
    "value_outcomes": "SELECT CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'leaked_despite_detection' ELSE 'missed_leaked' END WHEN l_linenumber % 2 = 0 THEN 'detected_removed' WHEN l_linestatus = 'F' THEN 'gate_saved' ELSE 'removed_unattributed' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1",
    "overhead_ms": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN greatest(o_totalprice - o_totalprice / 4, 0.0) ELSE o_totalprice / 10 END, 4) AS overhead_ms FROM orders",
    "resolve_overlaps": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY start - "end", {_PRIO}, list_position(['mask','generalize','keep'], action), start, "end", type, span_no) AS k FROM ({_SPANS}) WHERE "end" > start),
      g AS (SELECT slot_id, list([{{'a': start, 'z': "end", 't': type, 'n': action, 'o': source, 'i': span_no}}] ORDER BY k) AS xs FROM s GROUP BY slot_id),
      c AS (SELECT slot_id, unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].a < y.z AND y.a < x[1].z)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS u FROM g)
      SELECT slot_id, u.a AS start, u.z AS "end", u.t AS type, u.n AS action, u.o AS source, u.i AS span_no FROM c""",
    "protection_policy": f"""WITH s AS ({_SPANS}), a AS (SELECT 'minimal' AS level, source, type, CASE WHEN source IN ('llm', 'rule') AND type = 'QUASI_IDENTIFIER' THEN 'keep' ELSE action END AS action FROM s
      UNION ALL SELECT 'strict', source, type, CASE WHEN source IN ('llm', 'rule') AND action = 'generalize' THEN 'mask' ELSE action END FROM s) SELECT level, source, type, action, count(*) AS n FROM a GROUP BY ALL""",
    "span_agreement": f"""WITH s AS ({_SPANS}) SELECT x.slot_id, x.span_no AS a, y.span_no AS b, least(x."end", y."end") - greatest(x.start, y.start) AS shared, (least(x."end", y."end") - greatest(x.start, y.start)) * 2 >= least(x."end" - x.start, y."end" - y.start) AS agrees
      FROM s x JOIN s y ON x.slot_id = y.slot_id AND x.source = 'llm' AND y.source = 'gliner' AND x.start < y."end" AND y.start < x."end" """,
    "span_confidence": f"""WITH s AS (SELECT DISTINCT slot_id, start, "end", source, CASE WHEN span_no = 1 THEN 'jwt' ELSE 'other' END AS rule, span_no FROM ({_SPANS})),
      m AS (SELECT x.slot_id, x.start, x."end", x.source, x.rule, x.span_no, list_sort(list_distinct(list(y.source))) AS so FROM s x JOIN s y ON x.slot_id = y.slot_id AND x.start < y."end" AND y.start < x."end" GROUP BY ALL)
      SELECT slot_id, span_no, array_to_string(so, ',') AS sources, CASE WHEN rule = 'jwt' THEN 0.99 ELSE CASE WHEN len(so) > 1 THEN round(least(b + 0.25, 0.95), 2) ELSE b END END::DOUBLE AS confidence FROM (SELECT *, CASE source WHEN 'vault' THEN 1.0 WHEN 'regex' THEN 0.9 ELSE 0.6 END::DOUBLE AS b FROM m)""",
    "merged_intervals": f"""SELECT slot_id, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY slot_id ORDER BY start, "end", rn) AS g FROM (SELECT *, CASE WHEN max("end") OVER w IS NULL OR start > max("end") OVER w THEN 1 ELSE 0 END AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY start, "end") AS rn FROM ({_SPANS})) WINDOW w AS (PARTITION BY slot_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY slot_id, g""",
    "first_detections": f"SELECT slot_id, type, action, min(span_no) AS span_no FROM ({_SPANS}) GROUP BY slot_id, type, action",
    "quasi_score": "SELECT slot_id, sum(w)::BIGINT AS score FROM (SELECT DISTINCT l_orderkey AS slot_id, l_partkey % 7 AS c, CASE WHEN l_partkey % 7 < 4 THEN 2 ELSE 1 END AS w FROM lineitem) GROUP BY slot_id",
    "quasi_max_found": "SELECT case_id, max(n) AS max_found, max(n) >= 2 AS reidentified FROM (SELECT l_orderkey AS case_id, l_suppkey % 3 AS destination, count(DISTINCT l_partkey % 4) AS n FROM lineitem GROUP BY 1, 2) GROUP BY case_id",
    "allocation": f"WITH s AS (SELECT {_STRATUM} AS stratum, count(*) AS size FROM customer GROUP BY 1), e AS (SELECT *, least(60, (SELECT sum(size) FROM s)) * size / (SELECT sum(size) FROM s)::DOUBLE AS x FROM s) SELECT stratum, size, (floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, size DESC, stratum) <= least(60, (SELECT sum(size) FROM s)) - sum(floor(x)) OVER () THEN 1 ELSE 0 END)::BIGINT AS chosen FROM e",
    "stratified_sample": "WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS size FROM customer GROUP BY 1), e AS (SELECT *, least(100, (SELECT sum(size) FROM s)) * size / (SELECT sum(size) FROM s)::DOUBLE AS x FROM s), a AS (SELECT stratum, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, size DESC, stratum) <= least(100, (SELECT sum(size) FROM s)) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS chosen FROM e), r AS (SELECT c_mktsegment AS stratum, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_mktsegment || ':' || c_custkey), c_custkey) AS k FROM customer) SELECT r.stratum, c_custkey FROM r JOIN a USING (stratum) WHERE k <= chosen",
    "dev_test_split": f"SELECT c_custkey, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('11:' || stratum || ':' || c_custkey), c_custkey) <= round_even(count(*) OVER (PARTITION BY stratum) * 0.3, 0) THEN 'dev' ELSE 'test' END AS part FROM (SELECT c_custkey, {_STRATUM} AS stratum FROM customer)",
    "sliding_limiter": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "limiter_replay": """WITH g AS (SELECT user_id, list([{'t': epoch_us(ts), 'i': event_id, 'ok': true, 'w': NULL::DOUBLE}] ORDER BY ts, event_id) AS xs FROM events GROUP BY user_id),
      r AS (SELECT user_id, unnest(list_reduce(xs, lambda acc, x: list_append(acc, {'t': x[1].t, 'i': x[1].i,
        'ok': len(list_filter(acc, lambda y: y.ok AND x[1].t - y.t < 43200000000)) < 2,
        'w': CASE WHEN len(list_filter(acc, lambda y: y.ok AND x[1].t - y.t < 43200000000)) < 2 THEN NULL ELSE (43200000000 - (x[1].t - list_filter(acc, lambda y: y.ok AND x[1].t - y.t < 43200000000)[1].t)) / 1e6 END}))) AS u FROM g)
      SELECT user_id, u.i AS event_id, u.ok AS admitted, round(u.w, 3) AS retry_after FROM r""",
    "daily_budget": "SELECT event_id, round(s, 4) AS spent, s <= 50.0 AS within FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)",
    "latest_audit": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1",
    "recent_audit": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "model_shares": "SELECT event_type, count(*) AS n, round(avg((value > 50)::INT), 6) AS high_share, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "reuse_rows": "WITH h AS (SELECT *, sha256(o_custkey || '|' || o_orderpriority) AS h FROM orders), old AS (SELECT h, max(o_totalprice) AS old_score FROM h WHERE o_orderkey % 3 = 0 GROUP BY h) SELECT o_orderkey, coalesce(old_score, o_totalprice) AS score, old_score IS NOT NULL AS reused FROM h LEFT JOIN old USING (h)",
}
