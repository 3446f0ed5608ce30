"""Every detection rule over texts in which values of its kind stand, made from customers' names; what any rule finds is
compared, so a rule that finds another rule's values shows, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions import rules
from veilgrain.functions.session import table
from veilgrain.operators import detect, spans

H, N = "translate(md5(c_name), '0123456789', 'ghijklmnop')", "lpad(CAST(c_custkey % 9000 + 1000 AS VARCHAR(9)), 4, '0')"

#: rule: (what stands before the value, the value, what stands after it), in SQL that Spark and DuckDB both read; the rules that
#: find it, with what part of it, where that isn't the rule itself with all of it.
VALUES: dict[str, tuple[str, str, str, tuple[tuple[str, str], ...] | None]] = {
    "private_key_block": ("'key: '", f"'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {H} || chr(10) || '-----END RSA PRIVATE KEY-----'", "' end'", None),
    "connection_string": ("'db '", f"'postgres://user:' || {H} || '@db:5432/prod'", "' end'", None),
    "jwt": ("'t '", f"'eyJ' || {H} || '.eyJ' || {H} || '.' || {H}", "' end'", None),
    "openai_style_key": ("'k '", f"'sk-proj-' || {H}", "' end'", None),
    "nebius_key": ("'k '", f"'nb-' || {H}", "', end'", None),
    "tavily_key": ("'k '", f"'tvly-dev-' || {H}", "' end'", None),
    "aws_access_key_id": ("'id '", f"'AKIA' || upper(substr({H}, 1, 16))", "' end'", None),
    "aws_secret_access_key": ("'aws_secret_access_key = '", f"{H} || substr({H}, 1, 8)", "' end'", None),
    "github_token": ("'t '", f"'ghp_' || {H} || 'abcd'", "' end'", None),
    "slack_token": ("'t '", f"'xoxb-' || {H}", "' end'", None),
    "google_api_key": ("'g '", f"'AIza' || {H} || 'abc'", "' end'", None),
    "bearer_token": ("'Authorization: Bearer '", f"'z.' || {H}", "' end'", None),
    "password_assignment": ("'pwd='", f"'x1' || substr({H}, 1, 9)", "'; end'", None),
    "seed_phrase": ("'seed phrase: '", f"'river stone cloud amber tiger maple ocean lemon ' || substr({H}, 1, 8) || ' piano castle forest'", "'. End'", None),
    "password_phrase": ("'passcode is '", f"'x1' || substr({H}, 1, 9)", "', end'", (("code_after_cue", ""), ("password_phrase", ""))),
    "code_after_cue": ("'door code: '", f"{N} || '#'", "' end'", None),
    "webhook_url": ("'post to https://hooks.example'", f"'/services/T1/' || {H}", "' end'", None),
    "signed_url_param": ("'https://files.example/a?x=1&sig='", f"'q1' || substr({H}, 1, 20)", "' end'", None),
    "kr_case_number": ("'사건 '", f"'2021가합' || {N}", "' 판결'", None),
    "kr_address": ("'주소는 '", "'서울특별시 강남구 테헤란로 ' || CAST(c_custkey % 90 + 10 AS VARCHAR(9))", "' 이다'", None),
    "street_address": ("'at '", f"{N} || ' Marsh Hollow Street'", "' end'", None),
    "ticket_id": ("'see '", f"'QRS-' || {N}", "' end'", None),
    "kr_rrn": ("'no '", f"'900101-1' || {N} || '56'", "' end'", None),
    "kr_mobile": ("'call '", f"'010-' || {N} || '-5678'", "' end'", None),
    "kr_landline": ("'call '", f"'02)345-' || {N}", "' end'", None),
    "email": ("'mail '", f"'u' || {N} || '@mail.example'", "' end'", None),
    "card_number": ("'card '", "'4111 1111 1111 1111'", "' end'", None),
    "kr_bank_account": ("'acc '", f"'110-234-56' || {N}", "' end'", None),
    "intl_phone": ("'call '", f"'+44 20 7946 ' || {N}", "' end'", None),
}


def _named(rule: str):
    return lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value"))


def _letters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % len(VALUES)
    said = F.lit(None).cast("string")
    for i, (lead, value, tail, _) in enumerate(VALUES.values()):
        said = F.when(k == i, F.concat(F.expr(lead), F.expr(value.replace("VARCHAR(9)", "STRING")), F.expr(tail))).otherwise(said)
    return table(spark, d, "customer").select("c_custkey", said.alias("said"))


def planted_spans(spark: SparkSession, d: str) -> DataFrame:
    """The same letters through all detectors, with places: rules, high entropy, and what is found in disguise."""
    return detect.detected(_letters(spark, d), "said", "c_custkey").select("c_custkey", "start", "end", "type", "rule")


def planted_rules(spark: SparkSession, d: str) -> DataFrame:
    """(c_custkey, rule, value) of all that all rules find in letters that hold one value each."""
    letters = _letters(spark, d).select("c_custkey", rules.bare(F.col("said")).alias("t")).withColumn("low", F.lower("t"))
    found = F.array(*[F.transform(rules.values(F.col("t"), r, F.col("low")), _named(r.name)) for r in rules.RULES])
    return letters.select("c_custkey", F.explode(F.flatten(found)).alias("f")).select("c_custkey", "f.rule", "f.value")


WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def reader_views(spark: SparkSession, d: str) -> DataFrame:
    """Order numbers written apart, in words, in full-width digits, and with unseen characters between, as a reader sees them."""
    n = F.lpad(F.col("o_orderkey").cast("string"), 12, "4839201756")
    each = F.filter(F.split(n, ""), lambda c: c != "")
    spelled = F.array_join(F.transform(each, lambda c: F.element_at(F.array(*map(F.lit, WORDS)), c.cast("int") + 1)), " ")
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.array_join(each, " ")).when(k == 1, spelled).when(k == 2, F.translate(n, "0123456789", "０１２３４５６７８９")).otherwise(F.array_join(each, "\u200b"))
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("order "), said, F.lit(", please")).alias("said"))
    return detect.viewed(orders, "said", "o_orderkey")


def variant_places(spark: SparkSession, d: str) -> DataFrame:
    """Where customers' values stand in letters that write them in another case, with marks, with blanks, and broken over
    lines; parts of words don't count."""
    k, name = F.col("c_custkey") % 4, F.concat("c_mktsegment", F.lit(" Quill"))
    each = F.filter(F.split(name, ""), lambda c: ~c.isin("", " "))
    said = F.when(k == 0, F.lower(name)).when(k == 1, F.array_join(each, ".")).when(k == 2, F.replace(name, F.lit(" "), F.lit(" \n "))).otherwise(F.concat(F.lit("un"), name))
    slots = table(spark, d, "customer").select(F.col("c_custkey").alias("req_id"), F.lit(1).alias("slot_id"), F.concat(F.lit("so "), said, F.lit(" it is")).alias("text"), name.alias("name"))
    own = slots.select("req_id", F.lit(0).alias("slot_id"), F.lit(0).alias("start"), F.lit("ORG").alias("type"), F.lit("mask").alias("action"), F.lit("user").alias("source"), F.lit("x").alias("rule"), F.col("name").alias("text"))
    return spans.propagate(slots.select("req_id", "slot_id", "text"), own).select("req_id", "start", "end")


QUERIES = (planted_rules, planted_spans, reader_views, variant_places)
_EACH = " UNION ALL ".join(f"SELECT c_custkey, '{rule}' AS rule, {part or value} AS value FROM customer WHERE c_custkey % {len(VALUES)} = {i}" for i, (name, (_, value, _, found)) in enumerate(VALUES.items()) for rule, part in (found or ((name, ""),)))
_PLACES = " UNION ALL ".join(
    f"SELECT c_custkey, length({lead})::INT AS start, length({lead} || {value})::INT AS \"end\", '{rules.BY_NAME[rule].kind}' AS type, '{rule}' AS rule FROM customer WHERE c_custkey % {len(VALUES)} = {i}"
    for i, (name, (lead, value, _, found)) in enumerate(VALUES.items())
    for rule, _ in (found or ((name, ""),))
)
SQL = {
    "planted_rules": _EACH,
    "planted_spans": _PLACES,
    "reader_views": "SELECT o_orderkey, 'order ' || lpad(o_orderkey::VARCHAR, 12, '4839201756') || ', please' AS view FROM orders",
    "variant_places": """SELECT c_custkey AS req_id, 3 AS start, (3 + CASE c_custkey % 4 WHEN 0 THEN length(c_mktsegment) + 6 WHEN 1 THEN 2 * (length(c_mktsegment) + 5) - 1 ELSE length(c_mktsegment) + 8 END)::INT AS "end" FROM customer WHERE c_custkey % 4 < 3""",
}
