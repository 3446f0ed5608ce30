"""Queries on places, and on generalizations that are made to follow from their values, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions import generalize
from veilgrain.functions.session import table
from veilgrain.operators import places, quasi, semantic

Spark, Frame = SparkSession, DataFrame
TOWNS = ("Falls", "Harbor", "Ridge")


def gazetteer(spark: Spark, d: str) -> Frame:
    """Regions, their nations, and three towns of each."""
    region = table(spark, d, "region").select("r_regionkey", F.initcap(F.lower("r_name")).alias("r"))
    nation = table(spark, d, "nation").select("n_regionkey", F.initcap(F.lower("n_name")).alias("n")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    towns = nation.select(F.explode(F.array(*[F.concat("n", F.lit(f" {t}")) for t in TOWNS])).alias("name"), F.col("n").alias("container"), F.lit("town").alias("kind"))
    return towns.union(nation.select(F.col("n").alias("name"), F.col("r").alias("container"), F.lit("country").alias("kind"))).union(region.select(F.col("r").alias("name"), none.alias("container"), none.alias("kind")))


def _letters(spark: Spark, d: str) -> Frame:
    """Customers' letters that name a town of their nation, a nation by its key, and something that isn't a place."""
    nation = table(spark, d, "nation").select("n_nationkey", F.initcap(F.lower("n_name")).alias("n"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    other = nation.select(F.col("n_nationkey").alias("_k"), F.col("n").alias("o"))
    c = c.join(other, F.col("c_custkey") % 25 == F.col("_k"))
    town = F.concat("n", F.lit(" "), F.element_at(F.array(*map(F.lit, TOWNS)), (F.col("c_custkey") % 3 + 1).cast("int")))
    return c.select("c_custkey", F.concat("c_name", F.lit(" of "), "c_mktsegment", F.lit(" moved from "), town, F.lit(" to "), "o", F.lit(", not to Sub"), F.lower("o"), F.lit(".")).alias("text"), town.alias("town"), "o", "n")


def place_mentions(spark: Spark, d: str) -> Frame:
    """Places that letters name, the longest where names overlap, with their outermost container."""
    return places.mentions(_letters(spark, d), "text", gazetteer(spark, d), "c_custkey")


def place_ancestors(spark: Spark, d: str) -> Frame:
    return places.ancestors(gazetteer(spark, d)).select("name", "ancestor", F.col("depth").cast("int").alias("depth"))


def place_generalizations(spark: Spark, d: str) -> Frame:
    """Towns by themselves, nations, phrases that hold more than a place, and proposals that name a region that holds them or another one."""
    rows = _letters(spark, d).withColumn("lang", F.lit("en"))
    k = F.col("c_custkey") % 4
    value = F.when(k == 0, F.col("town")).when(k == 1, F.concat("town", F.lit(", "), "n")).when(k == 2, F.col("o")).otherwise(F.concat(F.lit("the clerk of "), "town"))
    rows = rows.withColumns({"value": value, "said": F.concat(F.lit("somewhere in "), F.element_at(F.array(*map(F.lit, ("Asia", "Europe", "America"))), (F.col("c_custkey") % 3 + 1).cast("int")))})
    return places.generalized(rows, "value", "lang", gazetteer(spark, d), "c_custkey", proposed="said")


TODAY = date(2026, 1, 1)


def fixed_generalizations(spark: Spark, d: str) -> Frame:
    """Ages, years and places of parts, in slots of five kinds, with proposals that hold or don't."""
    k, age = F.col("p_partkey") % 5, (F.col("p_size") + 10).cast("string")
    p = table(spark, d, "part").join(table(spark, d, "nation").select("n_nationkey", F.initcap(F.lower("n_name")).alias("n")), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    lead = F.when(k == 0, "My clerk says I'm ").when(k == 1, "he was born in ").when(k == 2, "see the ").when(k == 3, "a port in ").otherwise("I know ")
    value = F.when(k == 0, age).when(k == 1, F.concat(F.lit("19"), age)).when(k == 2, F.concat(age, F.lit("-year-old"))).when(k == 3, F.col("n")).otherwise(F.concat(F.lit("a clerk, aged "), age, F.lit(", with twins at the plant")))
    said = F.when(k == 0, "in my 20s").when(k == 2, "40-something").when(k == 3, "a country in Asia").when(k == 4, "someone in their 30s").otherwise("")
    rows = p.select("p_partkey", F.concat(lead, value, F.lit(" today")).alias("slot_text"), F.length(lead).alias("start"), (F.length(lead) + F.length(value)).alias("end"), said.alias("replacement"), F.lit("QUASI_IDENTIFIER").alias("type"))
    rows = rows.repartition("p_partkey")  # few bytes, much work
    return places.fixed_generalizations(rows, TODAY, gazetteer(spark, d), "p_partkey").select("p_partkey", F.expr("end - start").alias("length"), "replacement", "outcome")


ENDINGS = (" disease", "itis", " plan", "-positive", ", the only syndrome", " 2024 infection", " of kin")


def health_terms(spark: Spark, d: str) -> Frame:
    """Words of parts with endings of diagnoses and others: diagnoses, and terms that may stay."""
    value = F.concat(F.lower(F.element_at(F.split("p_name", " "), 1)), F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int")))
    found = table(spark, d, "part").select(value.alias("v"))
    return found.groupBy(generalize.diagnosis_term(F.col("v"), (semantic.KO_HEALTH, semantic.EN_HEALTH)).alias("diagnosis"), generalize.health_term(F.col("v")).alias("term")).agg(F.count("*").alias("n"), F.min("v").alias("least"))


def arithmetic_numbers(spark: Spark, d: str) -> Frame:
    """Order keys in sentences that compute with them, that name them as accounts, and in others."""
    key = (F.col("o_orderkey") + 1000).cast("string")
    lead = F.element_at(F.array(F.lit("Is "), F.lit("account no. "), F.lit("see ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(lead, key, F.when(F.col("o_orderkey") % 4 == 0, " items").otherwise(" divisible by 7?")).alias("t"), F.length(lead).alias("a"), (F.length(lead) + F.length(key)).alias("b"))
    return rows.select("o_orderkey", generalize.arithmetic_number(F.col("t"), F.col("a"), F.col("b")).alias("computed"))


def relevant_attributes(spark: Spark, d: str) -> Frame:
    """Attributes of customers that their question takes up again, and others."""
    c = F.col("c_custkey")
    said = F.concat(F.lit("I am a nurse and joined in 1999. "), F.when(c % 3 == 0, "What do Nurse schedules say?").when(c % 3 == 1, "When did others, who joined, leave?").otherwise("Is it late?"))
    texts = table(spark, d, "customer").select("c_custkey", said.alias("said")).repartition("c_custkey")  # few bytes, much work
    return quasi.relevant(texts, "said", quasi.attributes(texts, "said", "c_custkey"), "c_custkey").select("c_custkey", "category", "relevant")


#: What customers belong to, and (offset, length, phrase) of what is found in it.
BELONGS = (
    ("Marsh Hollow High School", ((0, 24, "a high school"),)), ("the Local Library", ()), ("a five-member planning commission", ((2, 31, "a local board"),)), ("a 400-employee firm", ()), ("Fort Quill", ((0, 10, "a military base"),)),
    ("새론초등학교", ((0, 6, "한 초등학교"),)), ("우리 교회", ()), ("3학년 2반", ((0, 6, "3학년"),)), ("직원 12명", ((3, 3, "10여 명"),)), ("the 3rd Ranger Battalion", ((4, 20, "a military unit"),)),
)


def institution_attributes(spark: Spark, d: str) -> Frame:
    """Institutions, classes and groups that customers say they belong to."""
    k = (F.col("c_custkey") % len(BELONGS) + 1).cast("int")
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(", of "), F.element_at(F.array(*[F.lit(b) for b, _ in BELONGS]), k), F.lit(", asks.")).alias("said"))
    return quasi.institution_attributes(rows, "said", "c_custkey").select("c_custkey", "start", "end", "phrase")


QUERIES = (institution_attributes, health_terms, arithmetic_numbers, relevant_attributes, place_mentions, place_ancestors, place_generalizations, fixed_generalizations)

_INITCAP = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_NATION = f"SELECT n_nationkey AS k, {_INITCAP.format('n_name')} AS n, {_INITCAP.format('r_name')} AS r FROM nation JOIN region ON n_regionkey = r_regionkey"
_LETTERS = f"""SELECT c_custkey, c_name || ' of ' || c_mktsegment || ' moved from ' AS lead, a.n || ' ' || ['Falls', 'Harbor', 'Ridge'][(c_custkey % 3 + 1)::INT] AS town, a.n, a.r, b.n AS o, b.r AS br FROM customer JOIN ({_NATION}) a ON a.k = c_nationkey JOIN ({_NATION}) b ON b.k = c_custkey % 25"""

_BELONGS = ", ".join(f"({k}, {a}, {n}, '{p}')" for k, (_, found) in enumerate(BELONGS) for a, n, p in found)

SQL = {
    "institution_attributes": f"""WITH b(k, a, n, phrase) AS (VALUES {_BELONGS}) SELECT c_custkey, (length(c_name) + 5 + a)::INT AS start, (length(c_name) + 5 + a + n)::INT AS "end", phrase FROM customer JOIN b ON c_custkey % {len(BELONGS)} = k""",
    "health_terms": f"""WITH v AS (SELECT lower(split_part(p_name, ' ', 1)) || [{", ".join(repr(e) for e in ENDINGS)}][(p_partkey % {len(ENDINGS)} + 1)::INT] AS v, p_partkey % {len(ENDINGS)} AS k FROM part)
      SELECT k IN (0, 1, 3) AS diagnosis, k NOT IN (4, 5) AND length(v) <= 32 AS term, count(*) AS n, min(v) AS least FROM v GROUP BY 1, 2""",
    "arithmetic_numbers": "SELECT o_orderkey, o_orderkey % 3 <> 1 AND o_orderkey % 4 <> 0 AS computed FROM orders",
    "relevant_attributes": "SELECT c_custkey, 'role' AS category, c_custkey % 3 = 0 AS relevant FROM customer UNION ALL SELECT c_custkey, 'cohort', c_custkey % 3 = 1 FROM customer",
    "place_mentions": f"""WITH l AS ({_LETTERS}) SELECT c_custkey, length(lead)::INT AS start, (length(lead) + length(town))::INT AS "end", town AS place, r AS top FROM l
      UNION ALL SELECT c_custkey, (length(lead) + length(town) + 4)::INT, (length(lead) + length(town) + 4 + length(o))::INT, o, br FROM l""",
    "place_ancestors": f"WITH n AS ({_NATION}), t AS (SELECT n || ' ' || unnest(['Falls', 'Harbor', 'Ridge']) AS t, n, r FROM n) SELECT t AS name, n AS ancestor, 1 AS depth FROM t UNION ALL SELECT t, r, 2 FROM t UNION ALL SELECT n, r, 1 FROM n",
    "place_generalizations": f"""WITH l AS (SELECT *, ['Asia', 'Europe', 'America'][(c_custkey % 3 + 1)::INT] AS said, c_custkey % 4 AS q FROM ({_LETTERS}))
      SELECT c_custkey, CASE WHEN q = 0 THEN 'a town in ' || r WHEN q = 2 THEN 'a country in ' || br END AS phrase, said = CASE WHEN q = 2 THEN br ELSE r END AS consistent FROM l""",
    "fixed_generalizations": f"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS q, p_size + 10 AS age, (p_size + 10) // 10 * 10 AS t, n, r FROM part JOIN ({_NATION}) ON k = p_partkey % 25)
      SELECT p_partkey, CASE q WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 11 WHEN 3 THEN length(n) ELSE 41 END::INT AS length,
        CASE q WHEN 0 THEN CASE WHEN t = 10 THEN 'in my teens' ELSE 'in my ' || t || 's' END WHEN 1 THEN 'the 19' || t || 's' WHEN 2 THEN t || '-something' WHEN 3 THEN 'a country in ' || r ELSE 'someone in their ' || t || 's' END AS replacement,
        CASE WHEN (q = 0 AND t = 20) OR (q = 2 AND t = 40) OR (q = 3 AND r = 'Asia') OR (q = 4 AND t = 30) THEN 'unchanged' ELSE 'fixed' END AS outcome FROM p""",
}
