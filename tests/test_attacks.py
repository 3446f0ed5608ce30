"""Attackers' answers, what they recover, facts, raters, recordings, hops."""


import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilgrain.operators import attacks, egress


def test_objects_grades_and_salvage(spark):
    rows = [('{"match": true}', True), ('```json\n{"match": " False "}\n```', False), ('so: {"match": "TRUE"}.', True), ('{"match": 1}', None), ("[1]", None), ("", None), (None, None), ("{", None), ('{"match": null}', None)]
    df = spark.createDataFrame(rows, "t string, e boolean")
    assert all(r.g == r.e for r in df.select(attacks.grade(F.col("t")).alias("g"), "e").collect())
    cut = [('{"q": 1, "answer": "a b', "a b"), ('{"answer": "a \\"b\\" c"}', 'a "b" c'), ('{"answer": "x\\u00', "x"), ('{"answer": "one\\ntwo\\', "one\ntwo"), ("{}", ""), ('{"answer" : ""', "")]
    df = spark.createDataFrame(cut, "t string, e string")
    assert [(r.s, r.e) for r in df.select(attacks.salvaged(F.col("t")).alias("s"), "e").collect() if r.s != r.e] == []


def test_items(spark):
    said = '{"extracted_values": ["Ann", {"kind": "name", "value": "Bob"}, {"value": 3}, " ", null], "person_attributes": "x", "private_situation": 5}'
    df = spark.createDataFrame([(1, said), (2, "none"), (3, None)], "id int, said string")
    assert sorted((r.id, r.item, r.kind, r.value) for r in attacks.items(df, "said", "id").collect()) == [(1, "extracted_values", "", "Ann"), (1, "extracted_values", "name", "Bob")]


def test_recovered_and_scored(spark):
    values = spark.createDataFrame([(1, "Jane Doe", False, True), (1, "canary-77812", True, False), (2, "Bob Quill", False, True)], "case_id int, value string, is_canary boolean, is_identity boolean")
    attributes = spark.createDataFrame([(1, "a", ["nurse at Tulsa"], True, 2), (1, "b", ["two dogs"], True, 2), (1, "c", ["zzz"], False, 2)], "case_id int, attribute string, forms array<string>, is_identity boolean, k int")
    guesses = spark.createDataFrame([(1, "JANE DOE is a nurse at Tulsa"), (1, "Canary 77812"), (1, "has two dogs")], "case_id int, guess string")
    cases = spark.createDataFrame([(1, True, True, None, True), (2, False, True, None, True), (3, True, False, None, None)], "case_id int, sent boolean, sensitive boolean, intent_match boolean, situation_match boolean")
    out = {r.case_id: r for r in attacks.score_attacks(cases, values, attributes, guesses).collect()}
    assert (out[1].n_exact, out[1].n_partial, out[1].canary_recovered, out[1].quasi_found, out[1].quasi_reid, out[1].identity_recovered, out[1].situation_inferred, out[1].linkable) == (2, 0, True, 2, True, True, True, True)
    assert (out[2].n_exact, out[2].quasi_reid, out[2].identity_recovered, out[2].situation_inferred, out[2].linkable) == (0, None, False, False, False)
    assert (out[3].n_values, out[3].has_identity, out[3].identity_recovered, out[3].situation_inferred, out[3].linkable) == (0, False, None, None, None)
    facts = spark.createDataFrame([(1, "Jane Doe"), (1, "Jane Roe Marsh"), (1, "nothing")], "case_id int, fact string")
    assert [(r.n, r.exact, r.partial) for r in attacks.score_facts(facts, guesses, "case_id").collect()] == [(3, 1, 2)]


def test_classes_and_raters(spark):
    facts, classes = spark.createDataFrame([(1, "a"), (1, "b")], "s int, fact string"), spark.createDataFrame([(1, "a", "identity"), (1, "z", "situation")], "s int, fact string, class string")
    good, bad = attacks.classified(facts, classes, "s")
    assert [r["class"] for r in good.collect()] == ["identity"] and sorted((r.fact, r.problem) for r in bad.collect()) == [("b", "unclassified"), ("z", "unknown")]
    labels = spark.createDataFrame([(i, r, v) for i, vs in enumerate(["ttf", "fft", "tt", "ff"]) for r, v in zip("abc", (c == "t" for c in vs), strict=False)], "item int, rater string, label boolean")
    assert {(r["first"], r["second"]): (r.n, r.kappa) for r in attacks.rater_agreement(labels, "item", "rater", "label").collect()} == {("a", "b"): (4, 1.0), ("a", "c"): (2, -1.0), ("b", "c"): (2, -1.0)}


@settings(max_examples=300, deadline=None)
@given(st.text("01. -ab ", min_size=1, max_size=6), st.text("01. -abＡ\n", max_size=14))
def test_the_folded_form_loses_no_place(value, text):
    """What the pattern finds in a text, the automaton's folded form finds, too."""
    import unicodedata

    pattern = attacks.digit_pattern(value)
    if pattern and pattern.search(unicodedata.normalize("NFKC", text).casefold()):
        assert attacks.folded(value).strip() in attacks.folded(text)


def test_recorded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "call 010 5555-0142 now"), (2, "call 01055550142"), (3, "010--5555-0142"), (4, "custom Tom"), (5, "TOM."), (6, None), (7, "김민수는"), (8, "34 years, 345"), (9, "3 4")], "doc_id int, text string")
    values = spark.createDataFrame([(1, "010-5555-0142"), (2, "Tom"), (3, "김민수"), (4, "34"), (5, " "), (6, None)], "item long, value string")
    want = [(1, 1), (2, 1), (4, 2), (5, 2), (7, 3), (8, 4), (9, 4)]
    assert sorted(map(tuple, attacks.recorded(docs, values, "doc_id", "item").collect())) == want
    monkeypatch.setattr(attacks.scan, "BLOCK_BYTES", 20)
    assert sorted(map(tuple, attacks.recorded(docs, values, "doc_id", "item").collect())) == want


def test_hops_and_detector_views(spark):
    rows = [("r", 2, "upstream", "a", "b", []), ("r", 1, "search", "a", "a", None), ("r", 3, "search", "a", "a", ["x"]), ("q", 1, "search", None, None, [])]
    out = egress.hops(spark.createDataFrame(rows, "run_id string, step int, destination string, original string, payload string, reasons array<string>")).collect()
    assert sorted((r.run_id, r.hop, r.decision, r.payload) for r in out) == [("q", 1, "allow", None), ("r", 1, "allow", "a"), ("r", 2, "rewritten", "b"), ("r", 3, "block", None)]
    slots = spark.createDataFrame([(1, "Ann met Bob and ann")], "slot_id int, text string")
    spans = spark.createDataFrame([(1, 0, 3, "PERSON", "mask", "rule", "Ann"), (1, 8, 11, "PERSON", "mask", "rule", "Bob"), (1, 16, 19, "PERSON", "mask", "rule", "ann")], "slot_id int, start int, end int, type string, action string, source string, text string")
    assert egress.masked_for_detector(slots, spans).first().masked == "<PERSON_1> met <PERSON_2> and <PERSON_1>"


def test_terms(spark):
    df = spark.createDataFrame([("a", "sensitive"), ("b", "canary")], "text string, kind string")
    assert egress.terms(df, "canary").count() == 1 and egress.terms(df).count() == 2


@pytest.mark.parametrize(("value", "form"), [("010-5555 0142", "01055550142"), ("Ａ  b\n1 2", "a b 12"), ("1--2", "1--2")])
def test_folded(value, form):
    assert attacks.folded(value) == form
