"""Substitution as a fold, checks of replacements, restoring across cuts, JSON with places."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilgrain.functions import checks, jsonplaces
from veilgrain.functions.restoring import Held, Restorer
from veilgrain.operators import gate, jsontext, requests, scan, scoring, spans, substitution
from veilgrain.operators.substitution import Options, Session, Slot, Span, request_applied
from veilgrain.plans import exchange


def done(session, *slots, options=Options(), rejected=()):
    return [a for a, _ in request_applied(list(slots), session, options, rejected)]


def test_known_values_keep_their_mapping_in_any_writing():
    s = Session("c")
    [a] = done(s, Slot("Jane Doe met jane  doe and JANE DOE", (Span("Jane Doe", "PERSON"),)))
    assert a.text == "<PERSON_1> met <PERSON_1> and <PERSON_1>"
    [b] = done(s, Slot("Then Jane Doe and Bob", (Span("jane doe", "ORG"), Span("Bob", "PERSON"))))
    assert b.text == "Then <PERSON_1> and <PERSON_2>"
    assert b.detections == [("Jane Doe", "PERSON", "mask", "llm"), ("Bob", "PERSON", "mask", "llm")]


def test_generalizations_are_checked_fitted_and_refused():
    s = Session("c")
    spans_ = (Span("Senior Architect", "QUASI_IDENTIFIER", "generalize", replacement="an employee"), Span("Tulsa plant", "LOCATION", "generalize", replacement="the Tulsa area"))
    [a] = done(s, Slot("the Senior Architect of our Tulsa plant", spans_))
    assert a.text == "the employee of our <LOCATION_1>" and a.refused == 1
    [b] = done(s, Slot("Senior Architect", (spans_[0],)))
    assert b.text == "an employee"
    [c] = done(Session("k"), Slot("저는 마흔다섯이야", (Span("마흔다섯", "QUASI_IDENTIFIER", "generalize", replacement="40대"),)))
    assert c.text == "저는 40대야"


def test_levels_reviews_and_json_keys():
    quasi = Span("left-handed", "QUASI_IDENTIFIER", "generalize", "rule", replacement="skilled")
    assert done(Session("c"), Slot("a left-handed man", (quasi,)), options=Options("minimal"))[0].text == "a left-handed man"
    assert done(Session("c"), Slot("a left-handed man", (quasi,)), options=Options("strict"))[0].text == "a <QUASI_IDENTIFIER_1> man"
    assert done(Session("c"), Slot("Ann and Bob", (Span("Ann", "PERSON"), Span("Bob", "PERSON"))), rejected=["ann"])[0].text == "Ann and <PERSON_1>"
    body = '{"doc": "doc", "x" : ["doc"], "y": "say \\"doc\\" twice"}'
    assert done(Session("c"), Slot(body, (Span("doc", "TERM"),), True))[0].text == '{"doc": "<TERM_1>", "x" : ["<TERM_1>"], "y": "say \\"<TERM_1>\\" twice"}'
    only_key = done(Session("c"), Slot('{"doc": 1}', (Span("doc", "TERM"),), True))[0]
    assert only_key.text == '{"doc": 1}' and only_key.protected == []


def test_overlaps_longest_first_and_places():
    [a] = done(Session("c"), Slot("call 010-1234-5678 now", (Span("1234", "ID_NUMBER", start=9, end=13), Span("010-1234-5678", "CONTACT", start=5, end=18))))
    assert a.text == "call <CONTACT_1> now"
    assert [a.text[x[2] : x[3]] for x in a.places] == ["<CONTACT_1>"] and a.places[0][4] == "010-1234-5678"


def test_surrogates_collide_with_nothing_and_come_back():
    key = Options(surrogate_key=b"k")
    s = Session("c")
    text = "Dr. Maria Lopez of Northmere Clinic wrote to maria.lopez@clinic.org; Maria Lopez agreed."
    spans_ = (Span("Maria Lopez", "PERSON"), Span("Northmere Clinic", "ORG"), Span("maria.lopez@clinic.org", "CONTACT"))
    [a] = done(s, Slot(text, spans_), options=key)
    assert not any(x.text.casefold() in a.text.casefold() for x in spans_) and "<" not in a.text
    restorer = Restorer([(m.original, m.type, m.action, m.value) for m in s.mappings.values()])
    assert restorer.whole(a.text) == text
    assert done(Session("c"), Slot(text, spans_), options=key)[0].text == a.text != done(Session("d"), Slot(text, spans_), options=key)[0].text


def test_applied_over_tables_goes_on_from_known_mappings(spark):
    slots = spark.createDataFrame([("a", 2, 0, "Bob and Ann"), ("a", 1, 0, "Ann"), ("a", 1, 1, "Cy"), ("b", 1, 0, "Ann"), ("c", 1, 0, None)], "conv_id string, turn int, slot_no int, text string")
    own = spark.createDataFrame([("a", 2, 0, n) for n in ("Bob", "Ann")] + [("a", 1, 0, "Ann"), ("a", 1, 1, "Cy"), ("b", 1, 0, "Ann")], "conv_id string, turn int, slot_no int, text string").withColumns({"type": F.lit("PERSON"), "action": F.lit("mask"), "source": F.lit("user")})
    known = spark.createDataFrame([("b", "Zoe", "PERSON", "mask", "PERSON_7")], "conv_id string, original string, type string, action string, value string")
    out = {(r.conv_id, r.turn, r.slot_no): (r.text, [m.value for m in r.mapped]) for r in substitution.applied(slots, own, known=known).collect()}
    assert out == {("a", 1, 0): ("<PERSON_1>", ["PERSON_1"]), ("a", 1, 1): ("<PERSON_2>", ["PERSON_2"]), ("a", 2, 0): ("<PERSON_3> and <PERSON_1>", ["PERSON_3"]), ("b", 1, 0): ("<PERSON_8>", ["PERSON_8"]), ("c", 1, 0): ("", [])}


@pytest.mark.parametrize(
    ("value", "new", "others", "why"),
    [
        ("34 years old", "in their 30s", (), None), ("34", " ", (), "empty"), ("x", "y" * 121, (), "long"), ("Bob", "<PERSON_1>", (), "placeholder"), ("Bob", "a [man]", (), "characters"),
        ("Bob the chef", "the chef", (), "crop"), ("Bob", "a friend of ann", ("Ann",), "value"), ("김민지", "a person", (), "language"), ("Acme Paris", "a paris firm", (), "token"), ("room 512", "room 512-ish", (), "value"),
        ("한국어 통역사로 일하는", "통역사", (), "crop"), ("유일하게 통역사로 일하는", "어느 통역사", (), "token"),
    ],
)
def test_refusals(value, new, others, why):
    assert checks.refusal(value, new, others) == why


MAPPINGS = [
    ("Jane Doe", "PERSON", "mask", "PERSON_1"), ("4111 1111 1111 1111", "FINANCIAL", "mask", "FINANCIAL_1"), ("박민", "PERSON", "mask", "PERSON_2"),
    ("Kim Lee", "PERSON", "surrogate", "Alex Marsh"), ("Ann", "PERSON", "surrogate", "Alex"), ("Bright Care Clinic", "ORG", "surrogate", "Northmere Clinic"), ("남궁하람", "PERSON", "surrogate", "김서준"),
]
WORDS = ["<PERSON_1>", "< person_1 >", "[[PERSON_2]]", "가 왔다", "은", "이라고", " ", " ", "last 4 digits: ", "<FINANCIAL_1>", "PERSON_1", "_", "<PERSON_9>", "Alex", "  Marsh", "a", "Northmere", " Clinic", "김서준", "<PER", "&lt;", "&gt;", ".", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=14), st.lists(st.integers(0, 120), max_size=10))
def test_any_cut_of_a_stream_restores_the_same(words, cuts):
    restorer = Restorer(MAPPINGS)
    text = "".join(words)
    held, out = Held(), ""
    places = sorted({min(c, len(text)) for c in cuts})
    for a, b in zip([0, *places], [*places, len(text)], strict=True):
        out += restorer.feed(held, text[a:b])
    assert out + restorer.feed(held, "", True) == restorer.whole(text)


def test_restoring_of_forms_parts_and_particles():
    r = Restorer(MAPPINGS)
    assert r.whole("&lt; person_1 &gt; [[PERSON_2]]가 <PERSON_9>") == "Jane Doe 박민이 <PERSON_9>"
    assert r.whole("card ending in <FINANCIAL_1>, card <FINANCIAL_1>") == "card ending in 1111, card 4111 1111 1111 1111"
    assert r.whole("alex  marsh; Marsh; Northmere!") == "Kim Lee; Lee; Bright Care!"
    assert r.arguments('{"PERSON_1": "PERSON_1", "n": 1.50}') == '{"PERSON_1": "Jane Doe", "n": 1.50}'
    quoted = Restorer([('say "x"', "TERM", "mask", "TERM_1")])
    assert quoted.arguments("{broken <TERM_1>") == '{broken say \\"x\\"'
    assert json.loads(quoted.arguments('{"a": "<TERM_1>"}')) == {"a": 'say "x"'}


def test_responses():
    r = Restorer(MAPPINGS)
    body = {"id": "<PERSON_1>", "choices": [{"message": {"reasoning": {"a": [1]}, "content": "\n<PERSON_1>", "refusal": None, "tool_calls": [{"function": {"name": "<PERSON_1>", "arguments": '{"q": "<PERSON_1>"}'}}]}}]}
    out = json.loads(r.response(json.dumps(body)))
    assert out == {"id": "<PERSON_1>", "choices": [{"message": {"content": "Jane Doe", "refusal": None, "tool_calls": [{"function": {"name": "<PERSON_1>", "arguments": '{"q": "Jane Doe"}'}}]}}]}
    assert r.response("no json <PERSON_1>") == "no json <PERSON_1>"


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(JSON, st.booleans(), st.sampled_from([None, 1]))
def test_json_round_trips(value, ascii_only, indent):
    text = json.dumps(value, ensure_ascii=ascii_only, indent=indent)
    assert jsonplaces.rewritten(text, lambda leaf: leaf.value) == text
    for leaf in jsonplaces.leaves(text):
        assert text[leaf.start : leaf.end] == leaf.raw
        here = value
        for p in leaf.path:
            here = here[p]
        if leaf.kind == "string":
            assert here == leaf.value
    assert json.loads(jsonplaces.canonical(text)) == value
    assert json.loads(jsonplaces.readable(text)) == value
    other = json.dumps(value, ensure_ascii=not ascii_only, indent=3)
    assert jsonplaces.canonical(other) == jsonplaces.canonical(text)


def test_json_edges():
    for bad in ("", "{", "[1,]", '{"a":1,}', "01", '"a" 1', "[1 2]", '{"a" 1}', "tru", "1.", "[}", '{"a":}', "nul", "1x"):
        assert jsonplaces.tokens(bad) is None, bad
    deep = "[" * 20000 + "]" * 20000
    assert jsonplaces.canonical(deep) == deep
    drop = lambda text: jsonplaces.without(text, lambda p: p[-1] == "x")
    assert [drop(t) for t in ('{"x":1}', '{"x":1 , "b":2}', '{"b":2, "x": {"x":[1]} }', '{"b":2,"x":1,"c":3}', "x")] == ["{}", '{"b":2}', '{"b":2 }', '{"b":2,"c":3}', "x"]


def test_string_chars_and_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": "xy", "b": [{"c": "\\u00e9"}, 5, null]}'), (2, "plain"), (3, None)], "id int, body string")
    assert {r.id: r.chars for r in jsontext.string_chars(df, "body", "id").collect()} == {1: 3, 2: 0}
    assert [(r.path, r.kind, r.value) for r in jsontext.leaves(df, "body", "id").where("id = 2").collect()] == [("", "text", "plain")]


@settings(max_examples=150, deadline=None)
@given(st.text("ab A.\n", max_size=30), st.lists(st.text("abA. ", max_size=5), max_size=4))
def test_scrubbing_is_one_pass(text, originals):
    own = sorted({o.strip() for o in originals if len(o.strip()) >= 2}, key=lambda o: (-len(o), o))
    word = lambda c: c.isalnum()
    pattern = "|".join(("(?<!\\w)" if word(o[0]) else "") + r"\s+".join(map(re.escape, o.split())) + ("(?!\\w)" if word(o[-1]) else "") for o in own)
    naive = re.sub(pattern, "[REDACTED]", text, flags=re.IGNORECASE) if own else text
    SCRUBS.append((text, originals, naive))


SCRUBS: list = []


def test_scrubbed(spark):
    test_scrubbing_is_one_pass()
    rows = [*SCRUBS, ("a\\Eb [REDACTED]", ["a\\Eb", "REDACTED", "x"], "[REDACTED] [[REDACTED]]"), ("x", None, None)]
    df = spark.createDataFrame(rows, "t string, o array<string>, e string").repartition(1)
    assert all(r.e == r.s for r in df.select("e", gate.scrubbed(F.col("t"), F.col("o")).alias("s"), "o").collect() if r.o is not None)


def test_values_with_pattern_characters(spark):
    rows = [(1, "see C:\\Engineering(old) here", "C:\\Engineering(old)", "exact"), (2, "a\\Eb", "a\\Eb", "exact"), (3, "A\\QB", "a\\qb", "casefold"), (4, "x[1]{2}", "[1]", "exact"), (5, "none", "(", None)]
    df = spark.createDataFrame(rows, "i int, t string, v string, e string")
    assert [(r.i, r.x) for r in df.orderBy("i").select("i", scan.ascii_variant(F.col("t"), F.col("v")).alias("x")).collect()] == [(r[0], r[3]) for r in rows]


def test_propagated_places(spark):
    slots = spark.createDataFrame([(1, 1, "İİİ hello Ann Example"), (1, 2, "ann  example and annexample, ANN EXAMPLES")], "req_id int, slot_id int, text string")
    fields = "req_id int, slot_id int, start int, type string, action string, source string, rule string, text string"
    own = [(1, 1, 10, "PERSON", "keep", "user", "x", "Ann Example"), (1, 2, 0, "PERSON", "mask", "rule", "link:a", "ann  example")]
    out = sorted((r.slot_id, r.start, r.end, r.action, r.rule) for r in spans.propagate(slots, spark.createDataFrame(own, fields)).collect())
    assert out == [(1, 10, 21, "mask", "link:a"), (2, 0, 12, "mask", "link:a"), (2, 17, 27, "mask", "link:a")]
    assert spans.propagate(slots, spark.createDataFrame(own[:1], fields)).count() == 0


def test_scores_see_escapes_and_hidden_layers(spark):
    import base64

    out = spark.createDataFrame([(1, 0, "upstream", '{"m": "\\uae40\\ubbfc\\uc9c0"}'), (1, 1, "upstream", "q=" + base64.b64encode(b"the secret is swordfish").decode())], "case_id int, pass int, destination string, payload string")
    hits = scoring.found(out, spark.createDataFrame([(1, "김민지"), (1, "swordfish")], "case_id int, value string"))
    assert sorted((r["pass"], r.value, r.variant, r.kept) for r in hits.collect()) == [(0, "김민지", "exact", True), (1, "swordfish", "decoded:exact", False)]
    df = spark.createDataFrame([(" Ａnn ",)], "v string").select(scoring.hash_candidates(F.col("v")).alias("h")).first().h
    import hashlib

    assert hashlib.sha256(b"Ann").hexdigest() in df and len(df) == 3


def test_numbers_in_other_writings():
    assert scan.find("call 010 1234_5678 now", "010-1234-5678") == "digits"
    assert scan.find("one two three four five six seven", "1234567") == "numeral_words"
    assert scan.find("공일공 일이삼사 오육칠팔", "010-1234-5678") == "numeral_words"
    assert scan.find("one, two. three four five six seven", "1234567") is None


def test_articles(spark):
    rows = [("I'm a nurse", 6, "an expert", 4, "an expert"), ("the nurse", 4, "an expert", 4, "expert"), ("her only nurse", 9, "an expert", 9, "an expert"), ("see nurse", 4, "someone", 4, "someone"), ("an old nurse", 7, "a b", 7, "a b")]
    df = spark.createDataFrame(rows, "t string, s int, r string, e int, n string")
    got = df.select(requests.fitted_article(F.col("t"), F.col("s"), F.col("r")).alias("f"), "e", "n").collect()
    assert [(r.f.start, r.f.replacement) for r in got] == [(r.e, r.n) for r in got]


def test_answers_without_mappings_lose_their_reasoning_too(spark):
    body = json.dumps({"choices": [{"message": {"content": "\n no names <PERSON_1>", "reasoning": "hm"}}]})
    rows = spark.createDataFrame([("a", 0, body), ("b", 0, body)], "conv_id string, turn int, body string")
    known = spark.createDataFrame([("a", "Jane Doe", "PERSON", "mask", "PERSON_1")], "conv_id string, original string, type string, action string, value string")
    out = {r.conv_id: json.loads(r.body)["choices"][0]["message"] for r in jsontext.restored(rows, known, "conv_id", "body", "turn", kind="response").collect()}
    assert out == {"a": {"content": "no names Jane Doe"}, "b": {"content": "no names <PERSON_1>"}}


def test_a_common_word_like_a_hidden_name_is_not_the_name(spark, tmp_path):
    said = [(1, 0, "user", "Mentelles went home, mentelles they say, and onmentelles"), (1, 1, "user", "so did Orrascoga")]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(tuple(r) for r in exchange.restored_surrogates(spark, str(tmp_path)).select("turn", "text", "hidden").collect()) == [(t, s, True) for _, t, _, s in said]
