"""Span algebra, numbering, masking, restoring."""

from pyspark.sql import functions as F

from veilgrain.operators import quasi, spans, vault


def test_literal_spans_count_code_points(spark):
    df = spark.createDataFrame([(1, "😀 12 and 345"), (2, None), (3, "")], "id long, text string")
    assert [tuple(r) for r in spans.literal_spans(df, "text", "[0-9]+", "id").orderBy("start").collect()] == [(1, 2, 4, "12"), (1, 9, 12, "345")]


def test_resolve(spark):
    rows = [(1, 0, 5, "mask", "regex"), (1, 3, 10, "mask", "llm"), (1, 3, 10, "mask", "vault"), (1, 10, 12, "keep", "rule"), (1, 4, 4, "mask", "vault"), (2, 0, 1, "mask", "llm")]
    df = spark.createDataFrame(rows, "slot_id long, start int, end int, action string, source string")
    out = sorted(tuple(r) for r in spans.resolve(df).select("slot_id", "start", "end", "source").collect())
    assert out == [(1, 3, 10, "vault"), (1, 10, 12, "rule"), (2, 0, 1, "llm")]


def test_policy(spark):
    df = spark.createDataFrame([("llm", "QUASI_IDENTIFIER", "generalize"), ("gliner", "QUASI_IDENTIFIER", "generalize")], "source string, type string, action string")
    assert [r.action for r in spans.with_policy(df, "minimal").collect()] == ["keep", "generalize"]
    assert [r.action for r in spans.with_policy(df, "strict").collect()] == ["mask", "generalize"]


def test_mask_and_restore(spark):
    slots = spark.createDataFrame([("a", 1, "Ann met Bob and ann."), ("b", 1, "nothing"), ("c", 1, None)], "slot_id string, conv_id long, text string")
    found = spans.literal_spans(slots, "text", r"\b(?:Ann|ann|Bob)\b", "conv_id", "slot_id").withColumn("type", F.lit("PERSON"))
    numbers = vault.numbered(found, "conv_id", ["slot_id", "start"])
    done = vault.masked(slots, found, numbers, "slot_id", "conv_id")
    got = {r.slot_id: r.masked for r in done.collect()}
    assert got == {"a": "<PERSON_1> met <PERSON_2> and <PERSON_1>.", "b": "nothing", "c": None}
    known = spark.createDataFrame([(1, "<PERSON_1>", "Ann"), (1, "<PERSON_2>", "Bob")], "conv_id long, placeholder string, original string")
    answer = spark.createDataFrame([(1, "[[PERSON_1]] and <PERSON_9> and ＜PERSON_2＞")], "conv_id long, text string")
    assert vault.restored(answer, known, "conv_id").first().restored == "Ann and <PERSON_9> and Bob"


def test_numbers_go_on(spark):
    rows = [(1, 0, 0, "PERSON", "Ann"), (1, 0, 5, "PERSON", "Bob"), (1, 1, 0, "ORG", "ann"), (1, 1, 3, "PERSON", "Cid")]
    s = spark.createDataFrame(rows, "conv_id long, turn int, start int, type string, text string")
    known = vault.numbered(s.where("turn = 0"), "conv_id", ["turn", "start"])
    out = vault.numbered(s.where("turn = 1"), "conv_id", ["turn", "start"], known)
    assert sorted((r.norm, r.placeholder) for r in out.collect()) == [("ann", "<PERSON_1>"), ("bob", "<PERSON_2>"), ("cid", "<PERSON_3>")]


def test_propagate(spark):
    slots = spark.createDataFrame([(1, 0, "I am Zelda"), (1, 1, "zelda again")], "req_id long, slot_id int, text string")
    found = spark.createDataFrame([(1, 0, 5, "PERSON", "mask", "rule", "x", "Zelda")], "req_id long, slot_id int, start int, type string, action string, source string, rule string, text string")
    out = sorted((r.slot_id, r.start, r.end, r.rule) for r in spans.propagate(slots, found).collect())
    assert out == [(0, 5, 10, "propagated"), (1, 0, 5, "propagated")]


def test_propagate_every_place(spark):
    slots = spark.createDataFrame([(1, 0, "I am Zel.a\\E"), (1, 1, "zel.a\\e, Zel.a\\E.ZEL.A\\e; zelxa\\e\U0001f600zel.a\\E")], "req_id long, slot_id int, text string")
    found = spark.createDataFrame([(1, 0, 5, "PERSON", "mask", "rule", "x", "Zel.a\\E")], "req_id long, slot_id int, start int, type string, action string, source string, rule string, text string")
    out = sorted((r.slot_id, r.start, r.end) for r in spans.propagate(slots, found).collect())
    text = slots.where("slot_id = 1").first().text.lower()
    assert out == [(0, 5, 12), *[(1, i, i + 7) for i in range(len(text)) if text.startswith("zel.a\\e", i)]] and len(out) == 5


def test_quasi(spark):
    df = spark.createDataFrame([(1, "I am 34, a twin, and joined in 1998"), (2, "weather today")], "slot_id long, text string")
    found = quasi.attributes(df, "text", "slot_id")
    assert {r.slot_id: r.score for r in quasi.scores(found, "slot_id").collect()} == {1: 5}
    out = {r.category: r.phrase for r in quasi.coarsened(found, "balanced", "slot_id").collect()}
    assert out == {"cohort": "in the 1990s", "age": "in my 30s"}
    assert quasi.coarsened(found, "minimal", "slot_id").count() == 0
