"""Queries on attacks, raters, facts and recordings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.session import table
from veilgrain.operators import attacks, egress
from veilgrain.plans.fixtures import JUDGED, as_sql, rows
from veilgrain.plans.records import RUNS
from veilgrain.plans.text import CARD, EMAIL, PHONE, _found, _luhn, contact_spans

Spark, Frame = SparkSession, DataFrame


def attack_answers(spark: Spark, d: str) -> Frame:
    """Attackers' answers about parts, in fences, in prose, as plain texts and as objects, with what must be left out."""
    name, k = F.to_json(F.array("p_name")), F.col("p_partkey") % 4
    one = F.expr("substring(n, 2, length(n) - 2)")
    body = F.concat(F.lit('{"extracted_values": [{"kind": "name", "value": '), one, F.lit("}, "), one, F.lit(', {"value": " "}, 7, {"value": 3}], "person_attributes": [{"attribute": "type", "value": "'), F.col("p_type"), F.lit('"}], "private_situation": '), F.when(F.col("p_size") % 2 == 0, one).otherwise("null"), F.lit("}"))
    said = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("I think: "), body, F.lit(" so it is."))).otherwise(F.concat(F.lit("["), body))
    return table(spark, d, "part").withColumn("n", name).select("p_partkey", "p_name", "p_type", "p_size", said.alias("said"))


def attack_items(spark: Spark, d: str) -> Frame:
    return attacks.items(attack_answers(spark, d), "said", "p_partkey")


def attack_grades(spark: Spark, d: str) -> Frame:
    """Situations, and graders' verdicts as booleans, as words and as neither."""
    answers = attack_answers(spark, d)
    match = F.concat(F.lit('{"match": '), F.when(F.col("p_size") % 3 == 0, "true").when(F.col("p_size") % 3 == 1, '" False "').otherwise("1"), F.lit("}"))
    return answers.select("p_partkey", attacks.situation(F.col("said")).alias("situation"), attacks.grade(match).alias("verdict"))


def scored_attacks(spark: Spark, d: str) -> Frame:
    """Orders' customers as cases whose values some attackers guess in full, in part, or not at all."""
    c = table(spark, d, "customer").withColumn("case_id", F.col("c_custkey"))
    k = F.col("c_custkey") % 4
    word = F.concat(F.lit("Quill"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"), F.lit("son"))
    values = c.select("case_id", F.explode(F.array(F.struct(F.concat(word, F.lit(" Marsh")).alias("value"), F.lit(False).alias("is_canary"), F.lit(True).alias("is_identity")), F.struct(F.concat(F.lit("9000"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("value"), F.lit(True).alias("is_canary"), F.lit(False).alias("is_identity")))).alias("v")).select("case_id", "v.*")
    guesses = c.where(k < 3).select("case_id", F.explode(F.when(k == 0, F.array(F.concat(F.lit("it is "), F.upper(word), F.lit(" marsh")), F.lit("no"))).when(k == 1, F.array(F.concat(word, F.lit(" Thorn")))).otherwise(F.array(F.concat(F.lit("9000 "), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))))).alias("guess"))
    attributes = c.select("case_id", F.explode(F.array(F.struct(F.lit("a").alias("attribute"), F.array(word, F.lit("zzzzzz qqqqqq")).alias("forms"), F.lit(True).alias("is_identity")), F.struct(F.lit("b").alias("attribute"), F.array(F.lit("marsh")).alias("forms"), F.lit(True).alias("is_identity")), F.struct(F.lit("c").alias("attribute"), F.array(F.lit("zzzzzzzz")).alias("forms"), F.lit(False).alias("is_identity")))).alias("a")).select("case_id", "a.*", F.lit(3).alias("k"))
    cases = c.select("case_id", (k < 3).alias("sent"), (F.col("c_custkey") % 3 == 0).alias("sensitive"), F.lit(None).cast("boolean").alias("intent_match"), (F.col("c_custkey") % 5 == 0).alias("situation_match"))
    out = attacks.score_attacks(cases, values, attributes, guesses)
    return out.select("case_id", "n_values", "n_exact", "n_partial", "canary_recovered", "quasi_found", "quasi_found_exact", "quasi_reid", "identity_recovered", "situation_inferred", "linkable")


def scored_facts(spark: Spark, d: str) -> Frame:
    """Words of benchmark items as facts, against guesses made of documents' first words."""
    facts = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0)))).alias("fact"))
    guesses = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("item_id"), F.substring_index("text", " ", 40).alias("guess"))
    return attacks.score_facts(facts, guesses, "item_id")


def fact_classes(spark: Spark, d: str) -> Frame:
    """Facts without a class, classes without a fact, and how many facts each class has."""
    facts = table(spark, d, "part").where("p_partkey % 7 <> 0").select("p_size", F.col("p_name").alias("fact")).distinct()
    classes = table(spark, d, "part").where("p_partkey % 5 <> 0").select("p_size", F.col("p_name").alias("fact"), F.when(F.length("p_name") % 2 == 0, "identity").otherwise("situation").alias("class")).distinct()
    good, bad = attacks.classified(facts, classes, "p_size")
    return good.groupBy(F.col("class").alias("outcome")).agg(F.count("*").alias("n")).union(bad.groupBy("problem").agg(F.count("*")))


def judged_against_raw(spark: Spark, d: str) -> Frame:
    judged = rows(spark, d, JUDGED, "lineitem").groupBy("item", "system").agg(F.max("system_score").alias("system_score"))
    met = attacks.against_reference(judged, "item", "system", "raw", "system_score")
    return met.groupBy("system").agg(F.count("*").alias("n"), F.sum("system_score").alias("own"), F.sum("reference_system_score").alias("raw"))


def rater_kappas(spark: Spark, d: str) -> Frame:
    """Three raters label lineitems; every two of them are compared over what both have seen."""
    li = table(spark, d, "lineitem")
    label = lambda name, seen, c: li.where(seen).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.lit(name).alias("rater"), c.alias("label"))
    labels = label("a", "l_linenumber < 6", F.col("l_quantity") > 25).union(label("b", "l_linenumber > 1", F.col("l_quantity") + F.col("l_linenumber") > 27)).union(label("c", "l_partkey % 2 = 0", F.col("l_suppkey") % 2 == 0))
    return attacks.rater_agreement(labels, "item", "rater", "label")


AGENT_RUNS = """
SELECT *, CASE WHEN searches = 3 THEN NULL ELSE facts_exact > 0 END AS identity_recovered, facts_exact = 2 AS identity_leaked, facts_n AS identity_facts, facts_exact AS identity_facts_recovered, facts_n + 1 AS situation_facts, facts_partial AS situation_facts_recovered,
  situation AND steps > 4 AS situation_strict, CASE WHEN steps = 5 THEN NULL ELSE steps END AS rubric_utility, utility AS usefulness, search_blocked = 1 AS distortion FROM ({runs})
"""


def agent_rates(spark: Spark, d: str) -> Frame:
    runs = spark.sql(AGENT_RUNS.format(runs=RUNS), lineitem=table(spark, d, "lineitem"))
    return attacks.agent_metrics(runs, "mode", "pass")


def salvaged_answers(spark: Spark, d: str) -> Frame:
    """Arguments of calls that break off: at the end, inside an escape, and whole ones."""
    turns = table(spark, d, "conversations")
    body = F.expr("to_json(struct('x' AS q, concat(text, '\\n') AS answer))")
    k = F.col("turn") % 3
    said = F.when(k == 0, body).when(k == 1, F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(F.substring(body, F.lit(1), F.length(body) - 3))
    return turns.select("conv_id", "turn", attacks.salvaged(F.when(F.col("conv_id") % 9 == 0, F.lit("{}")).otherwise(said)).alias("answer"))


def recorded_values(spark: Spark, d: str) -> Frame:
    """Phone numbers that documents hold, stripped of their marks, in all documents."""
    found = contact_spans(spark, d).where("rule = 'phone'").select(F.regexp_replace("text", r"[^0-9]", "").alias("digits")).distinct()
    values = found.select(F.col("digits").cast("long").alias("item"), F.concat_ws(".", F.substring("digits", 4, 3), F.substring("digits", 7, 4)).alias("value"))
    return attacks.recorded(table(spark, d, "documents"), values, "doc_id", "item")


def egress_hops(spark: Spark, d: str) -> Frame:
    """Events as hops of their users' runs: what is sent is kept, what is blocked leaves its reason alone."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.when(F.col("event_type") == "click", "search").otherwise("upstream").alias("destination"), F.col("props").alias("payload"), F.col("props").alias("original"))
    e = e.withColumns({"payload": F.when(F.col("step") % 4 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")), "reasons": F.when(F.col("step") % 6 == 0, F.array(F.concat(F.lit("secret:"), F.col("step").cast("string")))).otherwise(F.array().cast("array<string>"))})
    return egress.hops(e).select("run_id", "step", "hop", "decision", "payload", F.array_join("reasons", ",").alias("reasons"))


def detector_views(spark: Spark, d: str) -> Frame:
    """Documents as a model sees them: values that rules found are tokens, numbered within the text."""
    found = contact_spans(spark, d)
    return egress.masked_for_detector(table(spark, d, "documents"), found, "doc_id").groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("masked", r"<(CONTACT|FINANCIAL)_\d+>", ""))).cast("int").alias("chars"), F.max(F.array_max(F.transform(F.regexp_extract_all("masked", F.lit(r"<CONTACT_(\d+)>"), F.lit(1)), lambda x: x.cast("int")))).alias("contacts"))


QUERIES = (attack_items, attack_grades, scored_attacks, scored_facts, fact_classes, judged_against_raw, rater_kappas, agent_rates, salvaged_answers, recorded_values, egress_hops, detector_views)

_JUDGED = as_sql(JUDGED, "lineitem")
_SHARE = lambda hit, among: f"round(count(*) FILTER (WHERE {hit})::DOUBLE / nullif(count(*) FILTER (WHERE {among}), 0), 6)"
_RATERS = """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS item, 'a' AS r, l_quantity > 25 AS v FROM lineitem WHERE l_linenumber < 6 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'b', l_quantity + l_linenumber > 27 FROM lineitem WHERE l_linenumber > 1 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'c', l_suppkey % 2 = 0 FROM lineitem WHERE l_partkey % 2 = 0),
  p AS (SELECT a.r AS first, b.r AS second, count(*) AS n, avg((a.v = b.v)::INT) AS o, avg(a.v::INT) AS pa, avg(b.v::INT) AS pb FROM l a JOIN l b ON a.item = b.item AND a.r < b.r GROUP BY a.r, b.r)"""

SQL = {
    "attack_items": """SELECT p_partkey, 'extracted_values' AS item, 'name' AS kind, p_name AS value FROM part UNION ALL SELECT p_partkey, 'extracted_values', '', p_name FROM part UNION ALL SELECT p_partkey, 'person_attributes', 'type', p_type FROM part""",
    "attack_grades": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS situation, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verdict FROM part",
    "scored_attacks": """WITH c AS (SELECT c_custkey AS case_id, c_custkey % 4 AS k, c_custkey % 3 = 0 AS sensitive, c_custkey % 5 = 0 AS s FROM customer),
      o AS (SELECT *, k = 0 AS got, CASE WHEN k = 0 THEN 2 WHEN k = 1 THEN 1 ELSE 0 END AS found FROM c)
      SELECT case_id, 2 AS n_values, CASE WHEN k IN (0, 2) THEN 1 ELSE 0 END AS n_exact, CASE WHEN k = 1 THEN 1 ELSE 0 END AS n_partial, k = 2 AS canary_recovered, found AS quasi_found, found AS quasi_found_exact, found >= 3 AS quasi_reid, got AS identity_recovered,
        CASE WHEN sensitive THEN k < 3 AND s END AS situation_inferred, CASE WHEN sensitive THEN got AND k < 3 AND s END AS linkable FROM o""",
    "fact_classes": """WITH f AS (SELECT DISTINCT p_size, p_name FROM part WHERE p_partkey % 7 <> 0), c AS (SELECT DISTINCT p_size, p_name FROM part WHERE p_partkey % 5 <> 0)
      SELECT CASE WHEN length(p_name) % 2 = 0 THEN 'identity' ELSE 'situation' END AS outcome, count(*) AS n FROM (SELECT * FROM f INTERSECT SELECT * FROM c) GROUP BY 1 UNION ALL SELECT 'unclassified', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM c) HAVING count(*) > 0 UNION ALL SELECT 'unknown', count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM f) HAVING count(*) > 0""",
    "judged_against_raw": f"WITH j AS (SELECT item, system, max(system_score) AS s FROM ({_JUDGED}) GROUP BY item, system) SELECT a.system, count(*) AS n, sum(a.s)::BIGINT AS own, sum(b.s)::BIGINT AS raw FROM j a JOIN j b ON b.item = a.item AND b.system = 'raw' AND a.system <> 'raw' GROUP BY a.system",
    "rater_kappas": f"{_RATERS} SELECT first, second, n, round(o, 6) AS agreement, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN (o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa FROM p",
    "agent_rates": f"""SELECT mode, pass, count(*) AS runs, {_SHARE('identity_leaked', 'identity_leaked IS NOT NULL')} AS identity_leak_rate, {_SHARE('identity_recovered', 'identity_recovered IS NOT NULL')} AS attack_identity_recovery_rate, round(sum(identity_facts_recovered)::DOUBLE / sum(identity_facts), 6) AS identity_fact_recovery,
      round(sum(situation_facts_recovered)::DOUBLE / sum(situation_facts), 6) AS situation_fact_recovery, {_SHARE('situation', 'situation IS NOT NULL')} AS situation_inference_rate, {_SHARE('situation_strict', 'true')} AS situation_inference_strict, {_SHARE('identity_recovered AND situation', 'identity_recovered IS NOT NULL')} AS linkable_disclosure_rate,
      round(avg(rubric_utility), 6) AS rubric_utility_mean, round(avg(usefulness), 6) AS pairwise_utility_mean, {_SHARE('distortion AND usefulness IS NOT NULL', 'usefulness IS NOT NULL')} AS distortion_rate FROM ({AGENT_RUNS.format(runs=RUNS.format(lineitem='lineitem'))}) GROUP BY mode, pass""",
    "salvaged_answers": "SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN '' WHEN turn % 3 = 2 THEN text ELSE text || chr(10) END AS answer FROM conversations",
    "recorded_values": rf"""WITH v AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(text, '{PHONE}')), '[^0-9]', '', 'g') AS d FROM documents), p AS (SELECT d, substr(d, 4) AS own, '(^|[^0-9a-z])' || array_to_string(string_split(substr(d, 4), ''), '[\s.\-]?') || '([^0-9a-z]|$)' AS r FROM v),
      t AS (SELECT doc_id, lower(text) AS t, regexp_replace(text, '[\s.\-]', '', 'g') AS flat FROM documents WHERE regexp_matches(text, '[0-9]')) SELECT doc_id, d::BIGINT AS item FROM t JOIN p ON contains(flat, own) AND regexp_matches(t, r)""",
    "detector_views": rf"""WITH v AS (SELECT doc_id, value, 'CONTACT' AS type FROM ({_found(EMAIL)}) UNION ALL SELECT doc_id, value, 'CONTACT' FROM ({_found(PHONE)}) UNION ALL SELECT doc_id, value, 'FINANCIAL' FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS dg FROM ({_found(CARD)})) WHERE {_luhn('dg')}),
      g AS (SELECT doc_id, sum(length(value)) AS gone, nullif(count(DISTINCT lower(value)) FILTER (WHERE type = 'CONTACT'), 0)::INT AS contacts FROM v GROUP BY doc_id)
      SELECT d.doc_id, (length(text) - coalesce(gone, 0))::INT AS chars, contacts FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "egress_hops": """SELECT user_id AS run_id, event_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS hop, CASE WHEN event_id % 6 = 0 THEN 'block' WHEN event_id % 4 = 0 THEN 'rewritten' ELSE 'allow' END AS decision, CASE WHEN event_id % 6 <> 0 THEN props || CASE WHEN event_id % 4 = 0 THEN ' ' ELSE '' END END AS payload,
      CASE WHEN event_id % 6 = 0 THEN 'secret:' || event_id ELSE '' END AS reasons FROM events""",
}
