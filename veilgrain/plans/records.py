"""Queries on requests, reviews and scored records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgrain.functions.session import table
from veilgrain.operators import jsontext, limits, metrics, requests, review, scoring, spans, vault
from veilgrain.plans.fixtures import SPANS, as_sql, rows
from veilgrain.plans.text import EMAIL, PHONE, contact_spans

Spark, Frame = SparkSession, DataFrame

#: Runs of an agent, derived from the data tables like the other fixtures.
RUNS = """
SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'guarded' ELSE 'unguarded' END AS mode, l_linenumber % 3 AS pass, CASE WHEN l_partkey % 10 = 0 THEN 'stopped' ELSE 'finished' END AS status,
  4 AS facts_n, l_partkey % 3 AS facts_exact, l_partkey % 5 AS facts_partial, l_suppkey % 2 AS search_exact, l_partkey % 7 = 0 AS situation, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 1 + l_partkey % 5 END AS utility,
  l_linenumber AS searches, CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS search_blocked, 3 + l_suppkey % 4 AS steps, l_extendedprice / 100.0 AS latency_s
FROM {lineitem}
"""


def _words(turns: Frame, pattern: str) -> Frame:
    return turns.select(F.col("conv_id").alias("case_id"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("value")).distinct()


def _first(words: Frame, n: int) -> Frame:
    return words.withColumn("attribute", F.row_number().over(Window.partitionBy("case_id").orderBy("value"))).where(F.col("attribute") <= n)


def _scored(spark: Spark, d: str) -> Frame:
    """Conversations as cases: capitalised words of user turns are protected; assistant turns are what was sent, most
    of them as JSON bodies."""
    turns = table(spark, d, "conversations")
    user = turns.where("role = 'user'")
    n = F.length("value")
    values = _words(user, r"(?<![A-Za-z0-9_])[A-Z][a-z]{5,}").withColumns({"is_canary": n % 5 == 0, "is_identity": n % 2 == 0})
    outbound = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("case_id"), (F.floor(F.col("turn") / 2) % 2).cast("int").alias("pass"), F.when(F.col("turn") % 4 == 1, "upstream").otherwise("search").alias("destination"), F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.to_json(F.struct(F.array(F.struct(F.col("role"), F.col("text").alias("content"))).alias("messages")))).alias("payload")
    )
    said = values.where(n % 3 == 0).groupBy("case_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("vault:TERM:"), F.substring(F.sha2("value", 256), 1, 12)))).alias("_said"))
    c = F.col("case_id")
    records = turns.select(F.col("conv_id").alias("case_id")).distinct().withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).join(said, "case_id", "left")
    records = records.withColumns(
        {
            "category": F.when(c % 3 == 0, "benign").when(c % 3 == 1, "health").otherwise("direct_pii"),
            "lang": F.when(c % 2 == 0, "ko").otherwise("en"),
            "status": F.when((c % 7 == 0) & (F.col("pass") == 1), "blocked").when((c % 13 == 0) & (F.col("pass") == 0), "error").otherwise("ok"),
            "gate_decision": F.when(c % 5 == 0, "block").otherwise("allow"),
            "reasons": F.when(c % 10 == 0, F.col("_said")),
            "block_reasons": F.when(c % 10 == 5, F.col("_said")),
            "overhead_ms": c * 1.5,
            "client_ms": c * 2.0,
        }
    ).drop("_said")
    detections = values.where(n % 4 != 0).select("case_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass"), F.sha2("value", 256).alias("text_sha256"), F.when(n % 7 == 0, "keep").when(n == 9, "Allow").when(n == 10, "pass").when(n == 11, F.lit(None)).when(n == 13, "generalize").otherwise("mask").alias("action"))
    attributes = _first(_words(user, r"(?<![A-Za-z0-9_])[a-z]{9,}(?![A-Za-z0-9_])"), 3).withColumns({"is_identity": F.col("attribute") != 2, "k": F.lit(2)})
    keeps = _first(_words(user, r"(?<![A-Za-z0-9_])[a-z]{7}(?![A-Za-z0-9_])"), 2).select("case_id", "value")
    return scoring.score_cases(records, values, outbound, detections, attributes, keeps)


SCORED = (
    "case_id", "pass", "n_values", "n_values_leaked", "exact_leaked", "canary_count", "canary_leaked", "n_missed_leaked", "n_gate_saved", "n_attributed", "has_quasi", "quasi_reid", "leaked",
    "has_identity", "identity_leaked", "must_keep_total", "must_keep_missing", "masking_detections", "blocked",
)


def scored_cases(spark: Spark, d: str) -> Frame:
    """Score rows worked out from records: payloads, detections and gate reasons."""
    return _scored(spark, d).select(*SCORED)


RATES = ("leak_rate", "value_leak_rate", "canary_leak_rate", "quasi_reid_rate", "identity_leak_rate", "block_rate", "over_redaction_rate", "gate_save_rate", "gate_save_rate_attributed")


def scored_metrics(spark: Spark, d: str) -> Frame:
    return metrics.compute_metrics(_scored(spark, d), "pass", "lang").select("pass", "lang", "cases", "errors", *RATES)


def mode_rates(spark: Spark, d: str) -> Frame:
    return scoring.mode_metrics(rows(spark, d, RUNS, "lineitem"), "mode", "pass")


def observer_messages(spark: Spark, d: str) -> Frame:
    hops = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("hop_no"), F.when(F.col("role") == "assistant", "upstream").otherwise("search").alias("destination"), F.col("text").alias("content"))
    return scoring.observer_views(hops).groupBy("run_id", "view").agg(F.count("*").alias("n"))


def attribute_matches(spark: Spark, d: str) -> Frame:
    name = F.col("p_name")
    guess = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("it is the "), F.upper(name), F.lit("."))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("some "), F.split_part(name, F.lit(" "), F.lit(2)))).otherwise("nothing")
    return table(spark, d, "part").select("p_partkey", scoring.attribute_match(F.array(name, F.concat(name, F.lit(" 77"))), F.array(guess)).alias("match"))


def token_estimates(spark: Spark, d: str) -> Frame:
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(scoring.estimated_tokens(F.col("text"))).alias("tokens"))


def _spans(spark: Spark, d: str) -> Frame:
    return rows(spark, d, SPANS, "lineitem").withColumn("text", F.concat_ws("-", "type", F.col("span_no") % 3))


def decided_spans(spark: Spark, d: str) -> Frame:
    """After a review: values that the user kept are gone, and one of their own is there."""
    s = _spans(spark, d)
    rejected = s.where("slot_id % 7 = 0 and span_no = 2").select("slot_id", F.upper("text").alias("text"))
    added = s.where("slot_id % 11 = 0 and span_no = 1").withColumns({"span_no": F.lit(99).cast("long"), "text": F.lit("mine")})
    return review.decided(s.withColumn("span_no", F.col("span_no").cast("long")), rejected, added).groupBy("source").agg(F.count("*").alias("n"), F.sum("span_no").alias("total"))


def narrowed_spans(spark: Spark, d: str) -> Frame:
    return review.within_declared(_spans(spark, d)).groupBy("source", "action").agg(F.count("*").alias("n"))


def json_key_places(spark: Spark, d: str) -> Frame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"user": "'), F.col("user_id").cast("string"), F.lit('", "event": "user '), F.col("event_type"), F.lit('", "by" : ["user"], "user" : 1}')).alias("body"))
    found = spans.literal_spans(e, "body", "user", "event_id", "body")
    return found.select("event_id", "start", review.is_json_key(F.col("body"), F.col("start"), F.col("end")).alias("is_key"))


def review_list(spark: Spark, d: str) -> Frame:
    docs = table(spark, d, "documents")
    found = spans.literal_spans(docs, "text", EMAIL, "doc_id").withColumns({"type": F.lit("CONTACT"), "source": F.lit("regex"), "rule": F.lit("email")})
    return review.proposals(docs.select("doc_id", "text"), found, ["email"], "doc_id").select("doc_id", "span_no", "norm", "preview", "locked")


def review_reasons(spark: Spark, d: str) -> Frame:
    s = _spans(spark, d).withColumns({"req_id": F.col("slot_id") % 500, "discarded": F.col("span_no") == 7})
    return review.triggers(s)


def detector_counters(spark: Spark, d: str) -> Frame:
    li = table(spark, d, "lineitem")
    stats = li.select((F.col("l_orderkey") % 10).alias("req"), F.col("l_linenumber").alias("regex_spans"), (F.col("l_partkey") % 3).alias("llm_calls"), F.when(F.col("l_orderkey") % 10 < 5, F.col("l_suppkey") % 2).otherwise(0).alias("gliner_spans"))
    return review.counters(stats, "req", ensemble=("gliner_spans",))


BODIES = ('{"messages": [{"role": "user"}]}', '{"messages": []}', '{"messages": "x"}', "[1]", '{"messages": [{}, 1]}', "{", '{"a": 1}')
WHY = (None, "messages is empty", "messages is not an array", "not an object", "a message is not an object", "not an object", "messages is not an array")


def malformed_requests(spark: Spark, d: str) -> Frame:
    e = table(spark, d, "events")
    return e.select("event_id", requests.malformed(F.element_at(F.array(*map(F.lit, BODIES)), (F.col("event_id") % len(BODIES) + 1).cast("int"))).alias("why"))


def phone_shapes(spark: Spark, d: str) -> Frame:
    found = contact_spans(spark, d).where("rule <> 'card'").select("text").union(table(spark, d, "orders").select(F.concat(F.lit("010-"), F.col("o_orderkey").cast("string"), F.lit("-1234"))))
    return found.groupBy(requests.phone_like(F.col("text")).alias("phone")).agg(F.count("*").alias("n"))


def model_spans(spark: Spark, d: str) -> Frame:
    """Spans of a model's answer: fenced, with a repeat in other case, one that isn't in the text, one too short."""
    turns = table(spark, d, "conversations").withColumn("w", F.regexp_extract("text", r"\b([A-Z][a-z]{4,})", 1)).where("w <> ''")
    item = lambda w, t, a: F.concat(F.lit('{"text": "'), w, F.lit(f'", "type": "{t}", "action": "{a}", "replacement": "someone"}}'))
    body = F.concat_ws(", ", item(F.lit("zzqqzz"), "PERSON", "mask"), item(F.col("w"), "org", "generalize"), item(F.upper("w"), "ORG", "mask"), item(F.lit("x"), "ORG", "mask"), item(F.col("w"), "contact", "generalize"), item(F.col("w"), "WHAT", "mask"))
    said = turns.withColumn("content", F.concat(F.lit("<think>hm {</think>```json\n{\"spans\": ["), body, F.lit("]}\n```")))
    return requests.parsed_spans(said, "content", "text", "conv_id", "turn")


def looping_answers(spark: Spark, d: str) -> Frame:
    e = table(spark, d, "events").withColumn("said", F.concat(F.col("props"), F.expr("repeat(concat(' item ', event_id, ';'), cast(event_id % 7 as int))")))
    return e.select("event_id", requests.looping(F.col("said")).alias("loops"))


def placeholder_legends(spark: Spark, d: str) -> Frame:
    s = _spans(spark, d).withColumn("said", F.concat(F.lit("see <"), F.col("type"), F.lit("_"), F.col("span_no").cast("string"), F.lit(">")))
    return s.groupBy("slot_id").agg(requests.legend(F.collect_list("said")).alias("legend"))


#: Words that part names are given as departments: three of them each, so most rows of FUNCTIONS are met.
UNITS = ("data", "legal", "HR", "kitchen", "영업", "R&D", "sales", "sre", "garden", "품질", "brand", "물류", "ward", "it", "street", "감사", "lab", "admin", "security", "design")


def department_functions(spark: Spark, d: str) -> Frame:
    """Functions of departments whose names are made of a part's own words and of UNITS."""
    word = lambda n: F.element_at(F.array(*map(F.lit, UNITS)), (F.col("p_partkey") % n + 1).cast("int"))
    said = table(spark, d, "part").select(F.concat_ws(" ", F.split_part("p_type", F.lit(" "), F.lit(1)), word(len(UNITS)), F.split_part("p_name", F.lit(" "), F.lit(1)), word(7)).alias("department"))
    return said.groupBy(requests.function_of(F.col("department")).alias("function"), requests.function_of(F.col("department"), "ko").alias("ko")).agg(F.count("*").alias("n"))


def request_chars(spark: Spark, d: str) -> Frame:
    """Characters of all strings in requests: contents as texts, as parts, missing and null, with and without calls."""
    t, text = F.col("turn"), F.to_json(F.array("text"))
    one = F.regexp_extract(text, r"(?s)^\[(.*)\]$", 1)
    content = F.when(t % 3 == 0, one).when(t % 3 == 1, F.concat(F.lit('[{"type": "text", "text": '), one, F.lit('}, {"type": "image"}]'))).otherwise("null")
    calls = F.when(t % 4 == 2, F.concat(F.lit(', "tool_calls": [{"function": {"name": "f", "arguments": '), one, F.lit("}}]"))).otherwise("")
    message = F.concat(F.lit('{"role": "'), F.col("role"), F.when(t % 7 == 6, "").otherwise(F.concat(F.lit('", "content": '), content)), F.when(t % 7 == 6, '"').otherwise(""), calls, F.lit("}"))
    bodies = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit('{"messages": ['), F.array_join(F.collect_list(message), ", "), F.lit("]}")).alias("body"))
    return jsontext.string_chars(bodies, "body", "conv_id")


def fitted_articles(spark: Spark, d: str) -> Frame:
    """The words "the", "a" and "my" of turns, each followed by a span whose replacement has an article."""
    turns = table(spark, d, "conversations").withColumn("said", F.concat("text", F.element_at(F.array(F.lit(" and a "), F.lit(" and the "), F.lit(" so my\n"), F.lit(" then an "), F.lit(" by ")), (F.col("turn") % 5 + 1).cast("int")), F.lit("Senior Architect")))
    start = F.length("said") - 16
    fit = requests.fitted_article(F.col("said"), start, F.when(F.col("conv_id") % 4 == 0, "people").otherwise("an architect"))
    return turns.select("conv_id", "turn", fit.alias("f")).select("conv_id", "turn", "f.start", "f.replacement")


def admissions(spark: Spark, d: str) -> Frame:
    e = limits.recent(table(spark, d, "events"), "user_id", "ts", 86400)
    e = limits.spent(e, "ts", "value", 3000.0, "event_id")
    return e.select("event_id", requests.admission(F.col("recent"), 3, F.col("within"), F.length("props"), 8).alias("refused"))


def session_ids(spark: Spark, d: str) -> Frame:
    """Signed with one key; a session is good under that key alone."""
    token = F.substring(F.sha2("c_name", 256), 1, 24)
    own = table(spark, d, "customer").select("c_custkey", requests.signed(token, b"one").alias("session"))
    return own.select("c_custkey", requests.verified(F.col("session"), b"one").alias("good"), requests.verified(F.col("session"), b"two").alias("other"), requests.verified(F.concat("session", F.lit("x")), b"one").alias("longer"))


def order_flips(spark: Spark, d: str) -> Frame:
    return table(spark, d, "orders").select("o_orderkey", requests.order_flipped("utility", F.col("o_orderkey"), F.lit(1)).alias("flipped"))


def canonical_hashes(spark: Spark, d: str) -> Frame:
    fields = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("a"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", requests.canonical_hash(fields).alias("hash"))


def known_values(spark: Spark, d: str) -> Frame:
    """Later turns that hold a value their conversation knows already."""
    turns = table(spark, d, "conversations")
    s = spans.literal_spans(turns.where("turn < 2"), "text", r"\b[A-Z][a-z]{4,}", "conv_id", "turn").withColumn("type", F.lit("TERM"))
    known = vault.numbered(s, "conv_id", ["turn", "start"])
    met = turns.where("turn >= 2").join(known, "conv_id").where(F.contains(F.lower("text"), F.col("norm")))
    return met.groupBy("conv_id", "turn").agg(F.count("*").alias("values"), F.min("number").alias("first"))


QUERIES = (
    scored_cases, scored_metrics, mode_rates, observer_messages, attribute_matches, token_estimates, decided_spans, narrowed_spans, json_key_places, review_list, review_reasons, detector_counters, malformed_requests,
    phone_shapes, model_spans, looping_answers, placeholder_legends, department_functions, request_chars, fitted_articles, admissions, session_ids, order_flips, canonical_hashes, known_values,
)

_S = f"SELECT *, type || '-' || (span_no % 3) AS text FROM ({as_sql(SPANS, 'lineitem')})"
_WALKED = f"""SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start, m[i] AS value, t
  FROM (SELECT doc_id, m, p, t, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text AS t, regexp_extract_all(text, '{EMAIL}') AS m, regexp_split_to_array(text, '{EMAIL}') AS p FROM documents) WHERE len(m) > 0)"""
_CASES = r"""
WITH u AS (SELECT conv_id AS case_id, text FROM conversations WHERE role = 'user'),
v AS (SELECT DISTINCT case_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{5,}')) AS value FROM u),
a AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY value) AS attribute FROM (SELECT DISTINCT case_id, unnest(regexp_extract_all(text, '\b[a-z]{9,}\b')) AS value FROM u) QUALIFY attribute <= 3),
kp AS (SELECT * FROM (SELECT DISTINCT case_id, unnest(regexp_extract_all(text, '\b[a-z]{7}\b')) AS value FROM u) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY value) <= 2),
o AS (SELECT conv_id AS case_id, ((turn // 2) % 2)::INT AS pass, CASE WHEN turn % 4 = 1 THEN 'upstream' ELSE 'search' END AS destination, text AS p FROM conversations WHERE role = 'assistant'),
r AS (SELECT case_id, pass, CASE WHEN case_id % 2 = 0 THEN 'ko' ELSE 'en' END AS lang, CASE WHEN case_id % 7 = 0 AND pass = 1 THEN 'blocked' WHEN case_id % 13 = 0 AND pass = 0 THEN 'error' ELSE 'ok' END AS status, case_id % 5 = 0 AS gated
  FROM (SELECT DISTINCT conv_id AS case_id, unnest([0, 1]) AS pass FROM conversations)),
w AS (SELECT case_id, value FROM v UNION SELECT case_id, value FROM a UNION SELECT case_id, value FROM kp),
h AS (SELECT * FROM (SELECT o.case_id, pass, destination, value, CASE WHEN regexp_matches(p, '(^|[^A-Za-z0-9])' || value || '([^A-Za-z0-9]|$)') THEN 'exact' WHEN regexp_matches(lower(p), '(^|[^a-z0-9])' || lower(value) || '([^a-z0-9]|$)') THEN 'casefold'
  WHEN length(value) >= 8 AND contains(regexp_replace(lower(p), '\s+', '', 'g'), lower(value)) THEN 'whitespace' WHEN length(value) >= 8 AND contains(regexp_replace(lower(p), '[^\p{L}\p{N}]', '', 'g'), lower(value)) THEN 'alnum' END AS variant FROM o JOIN w ON w.case_id = o.case_id) WHERE variant IS NOT NULL),
hv AS (SELECT case_id, pass, value, bool_or(variant = 'exact') AS exact FROM h GROUP BY ALL),
x AS (SELECT r.case_id, r.pass, v.value, hv.value IS NOT NULL AS leaked, coalesce(hv.exact, false) AS exact, length(v.value) % 4 <> 0 AS detected, status = 'blocked' OR gated AS blocked, gated AND length(v.value) % 3 = 0 AS attributed, length(v.value) % 5 = 0 AS canary, length(v.value) % 2 = 0 AS identity
  FROM r JOIN v ON v.case_id = r.case_id LEFT JOIN hv ON hv.case_id = r.case_id AND hv.pass = r.pass AND hv.value = v.value),
y AS (SELECT case_id, pass, count(*) AS n_values, count(*) FILTER (WHERE leaked) AS n_values_leaked, bool_or(exact) AS exact_leaked, count(*) FILTER (WHERE canary) AS canary_count, bool_or(canary AND leaked) AS canary_leaked, bool_or(identity) AS hasv, bool_or(identity AND leaked) AS idl,
  count(*) FILTER (WHERE leaked AND NOT detected) AS n_missed_leaked, count(*) FILTER (WHERE NOT leaked AND NOT detected AND blocked) AS n_gate_saved, count(*) FILTER (WHERE NOT leaked AND NOT detected AND blocked AND attributed) AS n_attributed FROM x GROUP BY ALL),
q AS (SELECT case_id, pass, max(n) AS found, max(ni) AS foundi FROM (SELECT h.case_id, pass, destination, count(DISTINCT attribute) AS n, count(DISTINCT attribute) FILTER (WHERE attribute <> 2) AS ni FROM h JOIN a ON a.case_id = h.case_id AND a.value = h.value GROUP BY ALL) GROUP BY ALL),
z AS (SELECT case_id, count(*) AS size, count(*) FILTER (WHERE attribute <> 2) AS ids FROM a GROUP BY case_id),
t AS (SELECT case_id, count(*) AS total FROM kp GROUP BY case_id),
g AS (SELECT h.case_id, pass, count(DISTINCT h.value) AS kept FROM h JOIN kp ON kp.case_id = h.case_id AND kp.value = h.value WHERE variant IN ('exact', 'casefold', 'whitespace') GROUP BY ALL),
m AS (SELECT case_id, count(*) AS n FROM v WHERE length(value) % 4 <> 0 AND length(value) % 7 <> 0 AND length(value) NOT IN (9, 10, 11) GROUP BY case_id),
s AS (SELECT r.case_id, r.pass, r.lang, r.status, coalesce(n_values, 0) AS n_values, coalesce(n_values_leaked, 0) AS n_values_leaked, coalesce(exact_leaked, false) AS exact_leaked, coalesce(canary_count, 0) AS canary_count, coalesce(canary_leaked, false) AS canary_leaked, coalesce(n_missed_leaked, 0) AS n_missed_leaked,
  coalesce(n_gate_saved, 0) AS n_gate_saved, coalesce(n_attributed, 0) AS n_attributed, size IS NOT NULL AS has_quasi, coalesce(found, 0) >= 2 AND size IS NOT NULL AS quasi_reid, coalesce(n_values_leaked, 0) > 0 OR (coalesce(found, 0) >= 2 AND size IS NOT NULL) AS leaked,
  coalesce(hasv, false) OR coalesce(ids >= 2, false) AS has_identity, coalesce(idl, false) OR coalesce(foundi >= 2, false) AS identity_leaked, coalesce(total, 0) AS must_keep_total, CASE WHEN sent.n IS NOT NULL THEN coalesce(total, 0) - coalesce(kept, 0) END AS must_keep_missing, coalesce(m.n, 0) AS masking_detections, status = 'blocked' OR gated AS blocked
  FROM r LEFT JOIN y ON y.case_id = r.case_id AND y.pass = r.pass LEFT JOIN q ON q.case_id = r.case_id AND q.pass = r.pass LEFT JOIN z ON z.case_id = r.case_id LEFT JOIN t ON t.case_id = r.case_id LEFT JOIN g ON g.case_id = r.case_id AND g.pass = r.pass LEFT JOIN m ON m.case_id = r.case_id
  LEFT JOIN (SELECT case_id, pass, count(*) AS n FROM o GROUP BY ALL) sent ON sent.case_id = r.case_id AND sent.pass = r.pass)
"""
_UNIT = lambda n: f"[{', '.join(repr(u) for u in UNITS)}][(p_partkey % {n} + 1)::INT]"
_HELD = lambda w: f"regexp_matches(d, '(^|[^a-z]){w}([^a-z]|$)')" if w.isascii() else f"contains(d, '{w}')"
_FIRST = "CASE " + " ".join(f"WHEN {' OR '.join(map(_HELD, words))} THEN {i}" for i, (words, _, _) in enumerate(requests.FUNCTIONS, 1)) + " END"
_DEPARTMENTS = f"""WITH p AS (SELECT lower(concat_ws(' ', split_part(p_type, ' ', 1), {_UNIT(len(UNITS))}, split_part(p_name, ' ', 1), {_UNIT(7)})) AS d FROM part), k AS (SELECT {_FIRST} AS k FROM p)
      SELECT [{", ".join(repr(en) for _, _, en in requests.FUNCTIONS)}][k] AS function, [{", ".join(repr(ko) for _, ko, _ in requests.FUNCTIONS)}][k] AS ko, count(*) AS n FROM k GROUP BY k"""
_RATE = "round(count(*) FILTER (WHERE {0} AND status <> 'error')::DOUBLE / nullif(count(*) FILTER (WHERE {1} AND status <> 'error'), 0), 6)"
_SUMS = "round(sum({0}) FILTER (WHERE status <> 'error' AND {2})::DOUBLE / nullif(sum({1}) FILTER (WHERE status <> 'error' AND {2}), 0), 6)"
_KEPT = "must_keep_missing IS NOT NULL AND must_keep_total > 0"

SQL = {
    "scored_cases": f"{_CASES} SELECT {', '.join(c if c in ('case_id', 'pass') else f"CASE WHEN status <> 'error' THEN {c} END AS {c}" for c in SCORED)} FROM s",
    "scored_metrics": f"""{_CASES} SELECT pass, lang, count(*) AS cases, count(*) FILTER (WHERE status = 'error') AS errors, {_RATE.format('leaked AND (n_values > 0 OR has_quasi)', '(n_values > 0 OR has_quasi)')} AS leak_rate, {_SUMS.format('n_values_leaked', 'n_values', 'true')} AS value_leak_rate,
      {_RATE.format('canary_leaked AND canary_count > 0', 'canary_count > 0')} AS canary_leak_rate, {_RATE.format('quasi_reid AND has_quasi', 'has_quasi')} AS quasi_reid_rate, {_RATE.format('identity_leaked AND has_identity', 'has_identity')} AS identity_leak_rate, {_RATE.format('blocked', 'true')} AS block_rate,
      {_SUMS.format('must_keep_missing', 'must_keep_total', _KEPT)} AS over_redaction_rate, {_SUMS.format('n_gate_saved', 'n_gate_saved + n_missed_leaked', 'true')} AS gate_save_rate, {_SUMS.format('n_attributed', 'n_gate_saved + n_missed_leaked', 'true')} AS gate_save_rate_attributed FROM s GROUP BY pass, lang""",
    "mode_rates": f"""SELECT mode, pass, count(*) AS runs, round(count(*) FILTER (WHERE status = 'finished')::DOUBLE / count(*), 6) AS finished_rate, round(sum(facts_exact)::DOUBLE / sum(facts_n), 6) AS fact_recovery, round(sum(facts_partial)::DOUBLE / sum(facts_n), 6) AS fact_recovery_partial, round(count(*) FILTER (WHERE situation)::DOUBLE / count(*), 6) AS situation_inference,
      round(sum(search_exact)::DOUBLE / sum(facts_n), 6) AS search_only_fact_recovery, round(avg(utility), 6) AS utility_mean, round(sum(searches)::DOUBLE / count(*), 6) AS searches_per_run, round(sum(searches - search_blocked)::DOUBLE / sum(searches), 6) AS search_sent_rate, round(sum(search_blocked)::DOUBLE / sum(searches), 6) AS search_blocked_rate, round(sum(steps)::DOUBLE / count(*), 6) AS steps_mean, round(median(latency_s), 6) AS latency_s_p50
      FROM ({RUNS.format(lineitem='lineitem')}) GROUP BY mode, pass""",
    "observer_messages": "WITH h AS (SELECT conv_id, role = 'assistant' AS up, text AS c FROM conversations), a AS (SELECT conv_id, count(DISTINCT c) FILTER (WHERE up) AS u, count(*) FILTER (WHERE NOT up) AS s FROM h GROUP BY conv_id) SELECT conv_id AS run_id, 'all' AS view, u + s AS n FROM a UNION ALL SELECT conv_id, 'search', s FROM a WHERE s > 0",
    "attribute_matches": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' END AS match FROM part",
    "token_estimates": r"SELECT lang, sum(ceil(a / 4.0)::BIGINT + n - a)::BIGINT AS tokens FROM (SELECT lang, length(text) AS n, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS a FROM documents) GROUP BY lang",
    "decided_spans": f"""WITH s AS ({_S}), d AS (SELECT source, span_no FROM s WHERE NOT EXISTS (SELECT 1 FROM s r WHERE r.slot_id = s.slot_id AND r.slot_id % 7 = 0 AND r.span_no = 2 AND r.text = s.text) UNION ALL SELECT 'user', 99 FROM s WHERE slot_id % 11 = 0 AND span_no = 1) SELECT source, count(*) AS n, sum(span_no)::BIGINT AS total FROM d GROUP BY source""",
    "narrowed_spans": f"""WITH s AS ({_S}) SELECT source, action, count(*) AS n FROM s WHERE source IN ('vault', 'regex', 'rule') OR action = 'keep' OR NOT EXISTS (SELECT 1 FROM s v WHERE v.source = 'vault' AND v.slot_id = s.slot_id AND s.start <= v.start AND v."end" <= s."end" AND s."end" - s.start > v."end" - v.start) GROUP BY source, action""",
    "json_key_places": """WITH e AS (SELECT event_id, length('{"user": "' || user_id || '", "event": "') AS b, length('{"user": "' || user_id || '", "event": "user ' || event_type || '", "by" : ["') AS c FROM events)
      SELECT event_id, 2 AS start, true AS is_key FROM e UNION ALL SELECT event_id, b::INT, false FROM e UNION ALL SELECT event_id, c::INT, false FROM e UNION ALL SELECT event_id, (c + 9)::INT, true FROM e""",
    "review_list": f"""WITH f AS (SELECT *, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS norm FROM ({_WALKED})), k AS (SELECT *, start + length(value) AS stop FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY start) = 1)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS span_no, norm, CASE WHEN start > 24 THEN '…' ELSE '' END || substr(t, greatest(start - 24, 0) + 1, least(stop + 24, length(t)) - greatest(start - 24, 0)) || CASE WHEN stop + 24 < length(t) THEN '…' ELSE '' END AS preview, true AS locked FROM k""",
    "review_reasons": f"""WITH s AS (SELECT *, slot_id % 500 AS req_id FROM ({_S})), l AS (SELECT DISTINCT req_id FROM s x WHERE source IN ('llm', 'gliner') AND NOT EXISTS (SELECT 1 FROM s y WHERE y.slot_id = x.slot_id AND y.source NOT IN ('llm', 'gliner') AND x.start < y."end" AND y.start < x."end"))
      SELECT s.req_id, concat_ws(',', CASE WHEN l.req_id IS NOT NULL THEN 'llm_only_spans' END, CASE WHEN bool_or(span_no = 7) THEN 'discarded_spans' END, CASE WHEN bool_or(source = 'rule' AND type = 'QUASI_IDENTIFIER') THEN 'semantic_cues' END) AS reasons FROM s LEFT JOIN l ON l.req_id = s.req_id GROUP BY s.req_id, l.req_id""",
    "detector_counters": "SELECT l_orderkey % 10 AS req, sum(l_linenumber)::BIGINT AS regex_spans, sum(l_partkey % 3)::BIGINT AS llm_calls, CASE WHEN l_orderkey % 10 < 5 AND sum(l_suppkey % 2) > 0 THEN sum(l_suppkey % 2)::BIGINT END AS gliner_spans FROM lineitem GROUP BY l_orderkey % 10",
    "malformed_requests": f"SELECT event_id, CASE event_id % {len(WHY)} " + " ".join(f"WHEN {i} THEN " + (f"'{w}'" if w else "NULL") for i, w in enumerate(WHY)) + " END AS why FROM events",
    "phone_shapes": rf"""WITH t AS (SELECT unnest(regexp_extract_all(text, '{EMAIL}')) AS v FROM documents UNION ALL SELECT unnest(regexp_extract_all(text, '{PHONE}')) FROM documents UNION ALL SELECT '010-' || o_orderkey || '-1234' FROM orders),
      p AS (SELECT regexp_replace(v, '[\s().-]', '', 'g') AS c FROM t), s AS (SELECT regexp_matches(c, '^\+?\d{{9,15}}$') AND regexp_matches(c, '^(?:\+?82)?0?1[016789]|^(?:\+?82)?0(?:2|[3-6][1-5])|^\+?1?\d{{10}}$|^\+') AS phone FROM p)
      SELECT phone, count(*) AS n FROM s GROUP BY phone""",
    "model_spans": r"""WITH w AS (SELECT conv_id, turn, regexp_extract(text, '\b([A-Z][a-z]{4,})', 1) AS w FROM conversations) SELECT conv_id, turn, 1 AS span_no, w AS text, 'ORG' AS type, 'generalize' AS action, 'someone' AS replacement FROM w WHERE w <> '' UNION ALL SELECT conv_id, turn, 4, w, 'CONTACT', 'mask', NULL FROM w WHERE w <> ''""",
    "looping_answers": "SELECT event_id, event_id % 7 >= 5 AS loops FROM events",
    "placeholder_legends": f"SELECT slot_id, string_agg(DISTINCT '<' || type || '_n> is ' || CASE type WHEN 'PERSON' THEN 'a person''s name' WHEN 'ORG' THEN 'an organization''s name' ELSE 'an identifying personal detail' END, '; ' ORDER BY '<' || type || '_n> is ' || CASE type WHEN 'PERSON' THEN 'a person''s name' WHEN 'ORG' THEN 'an organization''s name' ELSE 'an identifying personal detail' END) AS legend FROM ({_S}) GROUP BY slot_id",
    "department_functions": _DEPARTMENTS,
    "request_chars": "SELECT conv_id, sum(length(role) + CASE WHEN turn % 7 = 6 THEN 0 WHEN turn % 3 = 0 THEN length(text) WHEN turn % 3 = 1 THEN length(text) + 9 ELSE 0 END + CASE WHEN turn % 4 = 2 THEN length(text) + 1 ELSE 0 END)::INT AS chars FROM conversations GROUP BY conv_id",
    "fitted_articles": """SELECT conv_id, turn, (length(text) + CASE WHEN conv_id % 4 = 0 THEN length(w) WHEN turn % 5 = 0 THEN 5 WHEN turn % 5 = 3 THEN 6 ELSE length(w) END)::INT AS start, CASE WHEN conv_id % 4 = 0 THEN 'people' WHEN turn % 5 IN (1, 2) THEN 'architect' ELSE 'an architect' END AS replacement
      FROM (SELECT *, [' and a ', ' and the ', ' so my ', ' then an ', ' by '][(turn % 5 + 1)::INT] AS w FROM conversations)""",
    "admissions": """WITH e AS (SELECT event_id, length(props) AS n, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent, sum(value) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM events)
      SELECT event_id, CASE WHEN n > 8 THEN 'too_long' WHEN recent > 3 THEN 'rate_limited' WHEN spent > 3000 THEN 'budget_spent' END AS refused FROM e""",
    "session_ids": "SELECT c_custkey, true AS good, false AS other, false AS longer FROM customer",
    "order_flips": "SELECT o_orderkey, substr(sha256('utility:' || o_orderkey || ':1'), 1, 1) < '8' AS flipped FROM orders",
    "canonical_hashes": """SELECT event_id, sha256('{"a":"' || event_type || '","k":"' || (props::JSON->>'k') || '"}') AS hash FROM events""",
    "known_values": r"""WITH v AS (SELECT conv_id, norm, row_number() OVER (PARTITION BY conv_id ORDER BY t, i) AS number FROM (SELECT conv_id, lower(w) AS norm, min(turn) AS t, arg_min(i, turn * 100000 + i) AS i FROM (SELECT conv_id, turn, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '\b[A-Z][a-z]{4,}') AS m FROM conversations WHERE turn < 2)) GROUP BY conv_id, lower(w)))
      SELECT c.conv_id, c.turn, count(*) AS "values", min(number) AS first FROM conversations c JOIN v ON v.conv_id = c.conv_id AND contains(lower(c.text), v.norm) WHERE c.turn >= 2 GROUP BY c.conv_id, c.turn""",
}
