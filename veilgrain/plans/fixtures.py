"""Records in the shapes that the metrics work on, derived from the data tables by plain arithmetic.

The tables hold no evaluation records, so these expressions, which Spark and DuckDB both run, stand in
for them.  {name} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgrain.functions.session import table

CASE_SCORES = """
SELECT o_custkey AS case_id, o_orderkey % 3 AS pass,
  CASE o_orderkey % 5 WHEN 0 THEN 'benign' WHEN 1 THEN 'finance' WHEN 2 THEN 'health' WHEN 3 THEN 'direct_pii' ELSE 'adversarial' END AS category,
  CASE WHEN o_custkey % 2 = 0 THEN 'ko' ELSE 'en' END AS lang,
  CASE WHEN o_orderkey % 37 = 0 THEN 'error' WHEN o_orderkey % 11 = 0 THEN 'blocked' ELSE 'ok' END AS status,
  o_orderkey % 11 = 0 AS blocked,
  o_orderkey % 4 AS n_values,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 4 ELSE 0 END AS n_values_leaked,
  o_orderkey % 7 = 0 AND o_orderkey % 4 > 0 AND o_orderkey % 2 = 0 AS exact_leaked,
  CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS canary_count,
  o_orderkey % 42 = 0 AS canary_leaked,
  o_orderkey % 5 = 2 AS has_quasi,
  o_orderkey % 15 = 2 AS quasi_reid,
  (o_orderkey % 7 = 0 AND o_orderkey % 4 > 0) OR o_orderkey % 15 = 2 AS leaked,
  o_orderkey % 3 = 1 AS has_identity,
  o_orderkey % 9 = 1 AS identity_leaked,
  o_orderkey % 5 AS must_keep_total,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN o_orderkey % 5 ELSE 0 END AS must_keep_missing,
  o_orderkey % 3 AS masking_detections,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 100.0 END AS overhead_ms,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice / 50.0 END AS client_ms,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 3 = 0 THEN o_orderkey % 4 ELSE 0 END AS n_missed_leaked,
  CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 4 ELSE 0 END AS n_gate_saved,
  CASE WHEN o_orderkey % 22 = 0 THEN o_orderkey % 4 ELSE 0 END AS n_attributed,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE md5(CAST(o_custkey * 10 + o_orderkey % 2 AS VARCHAR(20))) END AS outbound_hash,
  o_totalprice / 1000.0 AS detect_ms
FROM {orders}
"""

ATTACKS = """
SELECT l_orderkey AS case_id, CASE WHEN l_linenumber % 2 = 0 THEN 'ko' ELSE 'en' END AS lang,
  l_linenumber % 4 AS n_values,
  CASE WHEN l_partkey % 5 = 0 THEN l_linenumber % 4 ELSE 0 END AS n_exact,
  CASE WHEN l_partkey % 5 = 1 THEN l_linenumber % 4 ELSE 0 END AS n_partial,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 3 = 0 END AS identity_recovered,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 3 = 0 END AS situation_inferred
FROM {lineitem}
"""

JUDGED = """
SELECT l_orderkey AS item, CASE l_suppkey % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'regex' WHEN 2 THEN 'ner' ELSE 'full' END AS system,
  1 + CAST(l_quantity AS INT) % 5 AS system_score, 1 + l_partkey % 5 AS reference_score, l_linenumber = 7 AS distorted,
  l_quantity > 25 AS judge_a, l_quantity + l_linenumber > 27 AS judge_b
FROM {lineitem}
"""

SPANS = """
SELECT l_orderkey AS slot_id, CAST(l_partkey % 60 AS INT) AS start, CAST(l_partkey % 60 + l_quantity AS INT) AS "end",
  CASE l_linenumber % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'QUASI_IDENTIFIER' END AS type,
  CASE l_suppkey % 3 WHEN 0 THEN 'mask' WHEN 1 THEN 'generalize' ELSE 'keep' END AS action,
  CASE l_suppkey % 5 WHEN 0 THEN 'vault' WHEN 1 THEN 'regex' WHEN 2 THEN 'rule' WHEN 3 THEN 'llm' ELSE 'gliner' END AS source,
  l_linenumber AS span_no
FROM {lineitem} WHERE l_linenumber <= 7
"""


def rows(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A fixture as a DataFrame."""
    return spark.sql(sql.replace('"end"', "`end`"), **{n: table(spark, sf_dir, n) for n in names})


def as_sql(sql: str, *names: str) -> str:
    """A fixture as a DuckDB subquery."""
    return sql.format(**{n: n for n in names})
