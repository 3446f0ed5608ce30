"""Semantic rules, ensemble, surrogates, streams, sources."""

import json

from pyspark.sql import functions as F

from veilgrain.functions import generalize, surrogate
from veilgrain.operators import ensemble, semantic
from veilgrain.sources import files


def found(spark, rule, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = rule(df.withColumnRenamed("text", "t"), "t", "id").collect()
    for r in rows:
        assert texts[r.id][r.start : r.end] == r.text
    return {(r.id, r.text) for r in rows}


def test_rules(spark):
    assert found(spark, semantic.unique_roles, "She is the only female pilot here", "the only way out") == {(0, "only female pilot")}
    assert found(spark, semantic.health, "Weather. My wife was diagnosed with lupus.", "lupus is a disease", "저는 우울증이 있어요") == {(0, "lupus"), (2, "우울증")}
    assert found(spark, semantic.organizations, "at Halcyon Freight Systems now", "The Computer Systems", "IT Solutions") == {(0, "Halcyon Freight Systems")}
    assert found(spark, semantic.persons, "김민수 과장님이 왔다", "name: Jane Doe") == {(0, "김민수"), (1, "Jane Doe")}
    assert found(spark, semantic.birth_dates, "DOB: 1953-01-15 ok", "on 1953-01-15") == {(0, "1953-01-15")}


def test_term_types(spark):
    df = spark.createDataFrame([("Project Nightfall",), ("Halcyon Systems",), ("Jane Doe",), ("widget",)], "t string")
    assert [r.k for r in df.select(semantic.term_type(F.col("t")).alias("k")).collect()] == ["PROJECT", "ORG", "PERSON", "TERM"]


def test_generalize(spark):
    df = spark.createDataFrame([("45세 남성",), ("마흔다섯",), ("turned 52",), ("nothing",)], "t string")
    assert [r.a for r in df.select(generalize.age_of(F.col("t")).alias("a")).collect()] == [45, 45, 52, None]
    dates = spark.createDataFrame([("born March 5, 1980",), ("2020년 1월 2일",), ("13/40/2020",), ("85년생",)], "t string")
    out = dates.select(generalize.date_in(F.col("t")).cast("string").alias("d"), generalize.birth_year(F.col("t"), F.lit("2026-01-01").cast("date")).alias("y")).collect()
    assert [(r.d, r.y) for r in out] == [("1980-03-05", 1980), ("2020-01-02", 2020), (None, None), (None, 1985)]
    ok = spark.createDataFrame([("Jane", "a person"), ("Jane", "Jane D"), ("x", ""), ("id 12345", "number 12345")], "o string, r string")
    assert [r.k for r in ok.select(generalize.generalization_ok(F.col("o"), F.col("r")).alias("k")).collect()] == [True, False, False, False]


def test_ensemble(spark):
    p = spark.createDataFrame([(1, 1, 1, 0, 5, "PERSON", "name", True), (1, 1, 2, 10, 20, "PERSON", "name", True), (1, 1, 3, 30, 35, "ORG", "company", True), (1, 1, 4, 40, 45, "PERSON", "date", True), (1, 1, 5, 50, 55, "PERSON", "name", False), (1, 1, 6, 60, 65, "PERSON", "name", True)], "req_id long, slot_id long, proposal_id long, start int, end int, type string, label string, shape_ok boolean")
    a = spark.createDataFrame([(1, 0, 6, "mask"), (1, 12, 18, "mask")], "slot_id long, start int, end int, action string")
    personal = spark.createDataFrame([(1, False)], "req_id long, personal boolean")
    out = {r.proposal_id: r.verdict for r in ensemble.merged(p, a, personal).collect()}
    assert out == {1: "covered", 2: "added", 3: "topic", 4: "label", 5: "shape", 6: "pending"}


def test_surrogates():
    key = b"k"
    card = surrogate.surrogate("4111 1111 1111 1111", "FINANCIAL", key)
    assert card.endswith("1111") and not surrogate._luhn(card.replace(" ", ""))
    name = surrogate.surrogate("Jane Doe", "PERSON", key)
    assert name == surrogate.surrogate("Jane Doe", "PERSON", key) != "Jane Doe"
    assert surrogate.surrogate("Jane Doe", "PERSON", key, text=name) != name
    assert surrogate.surrogate("a@b.com", "CONTACT", key).endswith("@example.com")
    assert surrogate.fitted_particle("남궁하람", "가 왔다") == "이 왔다"
    assert surrogate.fitted_particle("서울", "으로 간다") == "로 간다"


def test_sources(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "b.jsonl").write_text('{"id": "x", "lang": "en", "category": "benign", "messages": [{"role": "user", "content": "hi"}]}\n')
    df, digest = files.cases(spark, str(tmp_path / "c" / "*.jsonl"))
    assert df.first().messages[0].content == "hi" and len(digest) == 64
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.md").write_text("\n# Title here\nbody")
    (tmp_path / "d" / "a.txt").write_text("First line")
    got = [(r.doc_id, r.name, r.title) for r in files.documents(spark, str(tmp_path / "d")).orderBy("doc_id").collect()]
    assert got == [("doc-1", "a.txt", "First line"), ("doc-2", "b.md", "Title here")]
    audit = spark.createDataFrame([("r", "2024-01-01 00:00:00", 1), ("r", "2024-01-02 00:00:00", 2)], "request_id string, created_at string, v int").withColumn("created_at", F.to_timestamp("created_at"))
    files.append_audit(audit, str(tmp_path / "audit"))
    assert [r.v for r in files.read_audit(spark, str(tmp_path / "audit")).collect()] == [2]
