"""Slots and ids of requests, check digits, institutions, windows, the vault's tables."""

import json

import pytest
from pyspark.sql import functions as F

from veilgrain.functions import checkdigits, institutions
from veilgrain.operators import jsontext, spans, vault


def test_slots_paths_and_what_cant_be_seen(spark):
    body = {"messages": ["x", {"role": "user", "content": None}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url"}, "s", {"type": "text", "text": 5}]}, {"tool_calls": [{"function": {"arguments": '{"q": 1}'}}, {"function": {}}, 3], "function_call": {"arguments": "z"}, "content": "b"}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "[1]"), (3, "{"), (4, None), (5, '{"messages": "x"}')], "id int, body string")
    assert sorted((r.id, r.slot_no, r.path, r.text, r.in_json) for r in jsontext.request_slots(df, "body", "id").collect()) == [
        (1, 0, "/messages/2/content/0/text", "a", False), (1, 1, "/messages/3/content", "b", False), (1, 2, "/messages/3/tool_calls/0/function/arguments", '{"q": 1}', True), (1, 3, "/messages/3/function_call/arguments", "z", True),
    ]
    assert sorted(r.reason for r in jsontext.uninspected(df, "body", "id").collect()) == ["uninspectable_content:image_url", "uninspectable_content:text"]
    ids = {r.id: r.conversation for r in jsontext.conversation_ids(df, "body", "id").collect()}
    assert ids[3] is None and len(set(ids.values())) == 3 and all(v is None or len(v) == 29 for v in ids.values())
    same = spark.createDataFrame([(1, '{"messages":[{"content":"h\\u00e9","role":"user"}]}'), (2, '{"x": 1, "messages": [{"role": "user", "content": "hé"}, {"role": "user", "content": "b"}]}')], "id int, body string")
    assert len({r.conversation for r in jsontext.conversation_ids(same, "body", "id").collect()}) == 1
    kept = jsontext.projected(spark.createDataFrame([(1, '{"user": "u", "model" : "m", "store": {"model": 1}}'), (2, "no json")], "id int, body string"), "body", ("model",), "id")
    assert {r.id: r.body for r in kept.collect()} == {1: '{"model" : "m"}', 2: "no json"}


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (checkdigits.luhn, ["4111 1111 1111 1111", "5500005555555559"], ["4111111111111112", "42", "", None]), (checkdigits.routing, ["021000021", "0110 0001 5"], ["021000022", "02100002"]), (checkdigits.iban, ["GB82 WEST 1234 5698 7654 32", "de89370400440532013000"], ["GB82WEST12345698765433", "GB82", "99"]),
        (checkdigits.business, ["220-81-62517", "1208147521"], ["220-81-62518", "123"]), (checkdigits.rrn, ["900101-1234568"], ["900101-1234567", "9"]),
    ],
)
def test_check_digits(spark, check, good, bad):
    rows = [(v, True) for v in good] + [(v, False) for v in bad]
    out = spark.createDataFrame(rows, "v string, e boolean").select("v", "e", check(F.col("v")).alias("ok")).collect()
    assert [r.v for r in out if bool(r.ok) != r.e] == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Marsh Hollow High School", [("Marsh Hollow High School", "a high school")]), ("the Local Library", []), ("The Marsh Library", [("Marsh Library", "a library")]), ("a five-member planning commission", [("five-member planning commission", "a local board")]), ("a 400-employee firm", []),
        ("새론초등학교에서", [("새론초등학교", "한 초등학교")]), ("저는 초등학교 교사", []), ("우리 교회", []), ("3학년 2반", [("3학년 2반", "3학년")]), ("직원 12명", [("12명", "10여 명")]), ("팀원 7명", [("7명", "10명 미만")]), ("직원 120명", []), ("누리별함", [("누리별함", "한 함정")]), ("새론주공 아파트", []), ("Fort Quill", [("Fort Quill", "a military base")]),
    ],
)
def test_institutions(text, found):
    assert [(text[f.start : f.end], f.phrase) for f in institutions.institutions(text)] == found


def test_windows_by_words_and_characters(spark):
    df = spark.createDataFrame([(1, "aa bb  cc dd ee ff"), (2, ""), (3, None), (4, "x" * 50 + " yy")], "id int, t string")
    out = sorted((r.id, r.window_no, r.start, r.window) for r in spans.word_windows(df, "t", "id", words=4, chars=100).collect())
    assert out == [(1, 0, 0, "aa bb  cc dd"), (1, 1, 10, "dd ee ff"), (4, 0, 0, "x" * 50 + " yy")]
    tight = sorted((r.window_no, r.window) for r in spans.word_windows(df.where("id in (1, 4)"), "t", "id", words=4, chars=6).where("id = 1").collect())
    assert tight[0] == (0, "aa bb") and tight[-1][1] == "ee ff"
    assert [r.window for r in spans.word_windows(df.where("id = 4"), "t", "id", words=4, chars=6).orderBy("window_no").collect()] == ["x" * 50, "yy"]


def test_vault_tables(spark):
    m = spark.createDataFrame([("c", 2, "B", "PERSON", "mask", "PERSON_2"), ("c", 1, "A", "PERSON", "mask", "PERSON_1")], "conv_id string, created_at int, original string, type string, action string, value string")
    assert [x.value for x in vault.loaded(m, "conv_id").first().mappings] == ["PERSON_1", "PERSON_2"]
    terms, mappings, counts = vault.reset(m.limit(1), m)
    assert terms.count() == mappings.count() == 0 and tuple(counts.first()) == (1, 2)
