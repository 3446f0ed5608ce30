"""Queries on proposals of models and on Korean names and roles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.session import table
from veilgrain.operators import linking, proposals, semantic, spans
from veilgrain.plans.exchange import PIECES, VALUE

Spark, Frame = SparkSession, DataFrame


def _proposed(spark: Spark, d: str) -> tuple[Frame, Frame]:
    """Capitalised words as proposals of a model: names and companies, some with the mark that follows, and weaker ones
    of a place, and of an unknown label, at the same places."""
    slots = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("slot_id"), "conv_id", "text")
    said = slots.withColumn("said", F.col("text"))
    own = spans.literal_spans(said, "text", VALUE, "slot_id", "said")
    n = F.length("text")
    marked = F.when(F.substring("said", F.col("end") + 1, F.lit(1)).isin(".", ","), F.col("end") + 1).otherwise(F.col("end"))
    own = own.select("slot_id", "start", marked.alias("end"), F.when(n % 3 == 0, "company_name").when(n % 3 == 1, "first_name").otherwise("last_name").alias("label"), (0.5 + n / 100.0).alias("score"), (n % 3 == 0).alias("firm"))
    weaker = own.where("firm").select("slot_id", "start", "end", F.explode(F.array(F.lit("city"), F.lit("planet"))).alias("label"), F.lit(0.4).alias("score"))
    return slots, own.drop("firm").union(weaker)


def proposal_candidates(spark: Spark, d: str) -> Frame:
    """Names that stand side by side become one candidate; of overlapping ones the best stays."""
    slots, own = _proposed(spark, d)
    return proposals.proposed(slots, own).select("slot_id", "start", "end", "label", "type", F.round("score", 6).alias("score"), "verdict")


def personal_requests(spark: Spark, d: str) -> Frame:
    turns = table(spark, d, "conversations").withColumnRenamed("conv_id", "req_id")
    own = spans.literal_spans(turns, "text", r"\b[A-Z][a-z]{9,}", "req_id").withColumns({"type": F.when(F.length("text") % 2 == 0, "PERSON").otherwise("ORG"), "action": F.when(F.length("text") % 4 == 0, "keep").otherwise("mask")})
    return proposals.personal_requests(turns, own)


PHONE_OF = "concat_ws('-', CAST(c_nationkey + 10 AS STRING), CAST(c_custkey % 900 + 100 AS STRING), CAST(c_custkey % 800 + 150 AS STRING), CAST(c_custkey % 9000 + 1000 AS STRING))"


def checked_spans(spark: Spark, d: str) -> Frame:
    """Customers' fields as spans of a model, under types that fit and types that don't."""
    k, segment = F.col("c_custkey") % 6, F.initcap(F.lower("c_mktsegment"))
    value = F.when(k == 0, F.concat(F.lit("Dr. "), segment, F.lit(" Smith's"))).when(k == 1, F.expr(PHONE_OF)).when(k == 2, F.concat(F.lit("customer #"), F.col("c_custkey").cast("string"))).when(k == 3, F.col("c_name")).when(k == 4, F.lower("c_mktsegment")).otherwise(F.concat(F.lit("db_"), F.lower("c_mktsegment")))
    kind = F.when(k.isin(0, 3), "PERSON").when(k == 1, "CONTACT").when(k == 2, "ID_NUMBER").when(k == 4, "ORG").otherwise("SECRET")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("see "), value, F.lit(" for more")).alias("slot_text"), value.alias("text"), kind.alias("type"), F.lit(4).alias("start"))
    return proposals.checked(rows, "c_custkey")


SURNAMES, GIVEN = ("김", "이", "박", "남궁", "선우", "강"), ("서준", "하윤", "도현", "지안", "민서", "예린", "수아")
FORMS = ("{}님이 왔다", "{} 과장님께 물었다", "저는 {}입니다", "담당자: {}", "{}가 왔다", "고객 문의: 최{} 대리님")


def korean_names(spark: Spark, d: str) -> Frame:
    """Letters with names before a title, after a label, in an introduction, and where nothing tells of a name."""
    c = F.col("c_custkey")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    name = F.concat(pick(SURNAMES, c), pick(GIVEN, F.floor(c / 6)))
    form = pick(FORMS, F.floor(c / 42))
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(": "), F.replace(form, F.lit("{}"), F.when(F.contains(form, F.lit("최{}")), pick(GIVEN, F.floor(c / 6))).otherwise(name)), F.lit(". 유일한 여성 약사도 <PERSON_1>과 왔다.")).alias("text"))
    return semantic.korean_spans(rows, "text", "c_custkey").select("c_custkey", "start", "end", "text", "rule")


#: What is added to turns, and (offset, length, replacement, rule, needs an organization) of what is linked in it.
TEAMS = (
    (". The Data Platform, Senior Project Architect", ((6, 13, "engineering team", "link:en_org_unit", False), (21, 24, "an architect", "link:en_role", False))),
    (". Our Legal Department is here", ((6, 16, "legal department", "link:en_org_unit", True),)),
    (". Someone turned 34 at the Oklahoma Falls plant", ((10, 9, "in their 30s", "link:en_age", False), (27, 20, "plant", "link:en_org_site", False))),
    (". Then a Senior Project Architect spoke", ((7, 26, "an architect", "link:en_role", True),)),
    (". Now we moved to Bend, OR", ((18, 8, "a town in Oregon", "link:en_city_state", False),)),
    (". The whole team saw the platform-data team", ((25, 18, "engineering team", "link:en_org_unit", True),)),
)


def linked_spans(spark: Spark, d: str) -> Frame:
    """Parts of organizations in turns: alone they count only once the conversation has named an organization."""
    turns = table(spark, d, "conversations")
    turns = turns.select("conv_id", "turn", F.concat("text", F.element_at(F.array(*[F.lit(t) for t, _ in TEAMS]), ((F.col("turn") + F.col("conv_id")) % len(TEAMS) + 1).cast("int"))).alias("text"))
    own = turns.where("conv_id % 2 = 0 and turn = 2").select("conv_id", "turn", F.lit(0).alias("start"), F.lit("ORG").alias("type"), F.lit("mask").alias("action"))
    return linking.linked(turns, own).select("conv_id", "turn", "start", "end", "replacement", "rule")


QUERIES = (linked_spans, proposal_candidates, personal_requests, checked_spans, korean_names)

_PERSONS = f"""SELECT *, sum(CASE WHEN before AND regexp_matches(piece, '^[ \\t\\r\\f\\v]*$') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS island
  FROM (SELECT *, length(w) % 3 <> 0 AS person, lag(length(w) % 3 <> 0) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM ({PIECES}) WHERE w IS NOT NULL)"""
_PICK = lambda xs, by: f"[{', '.join(repr(x) for x in xs)}][(({by}) % {len(xs)} + 1)::INT]"
_SEGMENT = "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"

_LINKS = ", ".join(f"({k}, {a}, {n}, '{phrase}', '{rule}', {str(needs).lower()})" for k, (_, found) in enumerate(TEAMS) for a, n, phrase, rule, needs in found)

SQL = {
    "linked_spans": f"""WITH l(k, a, n, replacement, rule, needs) AS (VALUES {_LINKS}), c AS (SELECT *, (turn + conv_id) % {len(TEAMS)} AS k, bool_or(conv_id % 2 = 0 AND turn = 2) OVER (PARTITION BY conv_id ORDER BY turn) AS known FROM conversations)
      SELECT conv_id, turn, (length(text) + a)::INT AS start, (length(text) + a + n)::INT AS "end", replacement, rule FROM c JOIN l ON l.k = c.k WHERE known OR NOT needs""",
    "proposal_candidates": f"""WITH p AS ({_PERSONS}) SELECT conv_id || '-' || turn AS slot_id, min(start)::INT AS start, max(start + length(w))::INT AS "end", arg_min(CASE WHEN length(w) % 3 = 1 THEN 'first_name' ELSE 'last_name' END, i) AS label, 'PERSON' AS type, round(min(0.5 + length(w) / 100.0), 6)::DOUBLE AS score,
        CASE WHEN count(*) <= 4 THEN 'ok' ELSE 'shape' END AS verdict FROM p WHERE person GROUP BY conv_id, turn, island
      UNION ALL SELECT conv_id || '-' || turn, start, (start + length(w))::INT, 'company_name', 'ORG', round(0.5 + length(w) / 100.0, 6)::DOUBLE, 'ok' FROM p WHERE NOT person""",
    "personal_requests": r"""WITH s AS (SELECT conv_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{9,}')) AS w FROM conversations)
      SELECT conv_id AS req_id, bool_or(regexp_matches(text, '(^|[^\p{L}\p{N}_])(I|(?i:me|my|mine|we|our|dad|mom|father|mother|wife|husband|son|daughter|brother|sister|friend|coworker|colleague|boss|client|customer|employer))([^\p{L}\p{N}_]|$)')) OR conv_id IN (SELECT conv_id FROM s WHERE length(w) % 4 = 2) AS personal FROM conversations GROUP BY conv_id""",
    "checked_spans": rf"""WITH p AS (SELECT *, {PHONE_OF} AS c_phone FROM customer), c AS (SELECT *, c_custkey % 6 AS k, regexp_matches(replace(c_phone, '-', ''), '^(?:(?:82)?0?1[016789]|(?:82)?0(?:2|[3-6][1-5])|1?\d{{10}}$)') AS phone FROM p)
      SELECT c_custkey, CASE WHEN k = 0 THEN {_SEGMENT} || ' Smith' WHEN k = 1 THEN c_phone WHEN k = 2 AND c_custkey > 999 THEN c_custkey::VARCHAR WHEN k = 2 AND c_custkey < 10 THEN 'customer #' || c_custkey END AS value,
        CASE WHEN k = 0 THEN 'PERSON' WHEN k = 1 THEN CASE WHEN phone THEN 'CONTACT' ELSE 'FINANCIAL' END WHEN k = 2 AND c_custkey > 999 THEN 'ID_NUMBER' WHEN k = 2 AND c_custkey < 10 THEN 'SECRET' WHEN k = 5 THEN 'code' ELSE 'shape' END AS type,
        CASE WHEN k = 0 OR (k = 2 AND c_custkey > 999) THEN 'trimmed' WHEN k = 1 THEN CASE WHEN phone THEN 'ok' ELSE 'retyped' END WHEN k = 2 AND c_custkey < 10 THEN 'retyped' ELSE 'dropped' END AS outcome FROM c""",
    "korean_names": f"""WITH c AS (SELECT c_custkey, length(c_mktsegment) + 2 AS n, {_PICK(SURNAMES, 'c_custkey')} || {_PICK(GIVEN, 'c_custkey // 6')} AS name, {_PICK(GIVEN, 'c_custkey // 6')} AS given, c_custkey // 42 % 6 AS f FROM customer),
      l AS (SELECT *, [name || '님이 왔다', name || ' 과장님께 물었다', '저는 ' || name || '입니다', '담당자: ' || name, name || '가 왔다', '고객 문의: 최' || given || ' 대리님'][(f + 1)::INT] AS t, [0, 0, 3, 5, -1, 7][(f + 1)::INT] AS o FROM c)
      SELECT c_custkey, (n + o)::INT AS start, (n + o + CASE WHEN f = 5 THEN 3 ELSE length(name) END)::INT AS "end", CASE WHEN f = 5 THEN '최' || given ELSE name END AS text, CASE WHEN f IN (2, 3) THEN 'ko_labeled_name' ELSE 'ko_honorific_name' END AS rule FROM l WHERE f <> 4
      UNION ALL SELECT c_custkey, (n + length(t) + 2)::INT, (n + length(t) + 11)::INT, '유일한 여성 약사'[1:9], 'ko_quasi' FROM l""",
}
