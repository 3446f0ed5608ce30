"""Places, containers and generalizations that have to follow from their values."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilgrain.functions import fitting
from veilgrain.functions.regions import Gazetteer
from veilgrain.operators import linking, places

ROWS = [
    ("성남시", "경기도", None), ("분당구", "성남시", None), ("강남구", "서울", None), ("Tulsa", "Oklahoma", None), ("Paris", "France", None), ("France", "Europe", "country"), ("Europe", None, None),
    ("New York City", "New York", None), ("York", "England", None), ("A", "B", None), ("B", "A", None), ("self", "self", None), (None, "x", None),
]
GAZETTEER = Gazetteer(ROWS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "name string, container string, kind string")


def test_ancestors_close_over_containers(table):
    found = {(r.name, r.ancestor): r.depth for r in places.ancestors(table).collect()}
    assert found[("Paris", "Europe")] == 2 and found[("분당구", "경기도")] == 2 and found[("A", "B")] == 1 and ("A", "A") not in found and ("self", "self") not in found
    assert {r.name: r.top for r in places.tops(table).collect()}["Paris"] == "Europe"


def test_mentions_are_the_same_by_matcher_and_by_join(spark, table, monkeypatch):
    texts = [(1, "In New York City, York or Paris; not Parisian."), (2, None), (3, "성남시 분당구, Tulsa"), (4, "Europe")]
    df = spark.createDataFrame(texts, "id int, text string")
    found = lambda: sorted(map(tuple, places.mentions(df, "text", table, "id").collect()))
    own = found()
    assert [(r[0], r[3], r[4]) for r in own] == [(1, "New York City", "New York"), (1, "York", "England"), (1, "Paris", "Europe"), (3, "성남시", "경기도"), (3, "분당구", "경기도"), (3, "Tulsa", "Oklahoma")]
    monkeypatch.setattr(places, "GAZETTEER_BYTES", 0)
    assert found() == own


def test_a_large_gazetteer_gives_what_a_small_one_does(spark, monkeypatch):
    """The part that a row asks for decides as all rows do: containers of containers, cycles, names with several rows,
    names inside words, Korean forms, regions that only a phrase names."""
    rows = [
        *ROWS, ("Tulsa", "Kansas", "town"), ("Lyon", None, "town"), ("Lyon", "France", "city"), ("Riga", "Latvia", "port"), ("Latvia", "Baltics", "country"), ("Baltics", "Europe", "region"), ("가평군", "경기도", "군"), ("X1", "A", "hut"), ("La Paz", "Bolivia", "city"),
        ("Paz", "Peru", "city"), ("Me-Too", "서울", "club"), ("", "Nowhere", "x"), ("Kars", "", "town"),
    ]
    table = spark.createDataFrame(rows, "name string, container string, kind string")
    values = ["Paris", "Riga", " Riga, Tulsa", "La Paz", "LaPaz", "Smith-Paris", "the Riga port", "가평", "가평군에서", "성남시 분당구", "서울", "A", "B", "X1", "self", "Lyon", "Kars", "Me-Too", "Nowhere", "Tulsa, OK", "", None]
    phrases = ["a city in Europe", "somewhere in Baltics", "경기도의 한 군", "서울 어딘가", "a hut in B", "a town in Latvia or Peru", "분당구 근처", "a place", "", None]
    pairs = [(i * 100 + j, v, ("en", "ko", None)[(i + j) % 3], s, f"it is {v} here" if v is not None else None, 6, 6 + len(v or ""), "QUASI_IDENTIFIER") for i, v in enumerate(values) for j, s in enumerate(phrases)]
    df = spark.createDataFrame(pairs, "id int, value string, lang string, said string, slot_text string, start int, end int, type string").withColumn("replacement", F.col("said"))
    texts = [(1, "Smith-Paris and Paris's, New York City"), (2, "X1,A.B 가평군 가평군은 St. Riga"), (3, ""), (4, None), (5, "Riga")]
    said = spark.createDataFrame(texts, "id int, text string")
    results = lambda: [
        sorted(map(str, found.collect()))
        for found in (places.generalized(df, "value", "lang", table, "id", proposed="said"), places.fixed_generalizations(df, date(2026, 1, 1), table, "id"), places.mentions(said, "text", table, "id"))
    ]
    small = results()
    assert len(small[0]) == len(small[1]) == len(pairs) and sum("'fixed'" in r for r in small[1]) > 60 and sum("'rejected'" in r for r in small[1]) > 20
    monkeypatch.setattr(places, "GAZETTEER_BYTES", 0)
    assert results() == small


def test_linking_by_a_large_gazetteer(spark, table, monkeypatch):
    texts = ["He turned 34 at the Tulsa plant.", "저는 성남 공장에서 일하고 마흔다섯 살이다", "the Corvenna site, a Senior Project Architect", "nothing", None]
    slots = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id int, turn int, text string")
    spans = spark.createDataFrame([(1, 0, 0, "ORG", "mask")], "conv_id int, turn int, start int, type string, action string")
    found = lambda: sorted(map(str, linking.linked(slots, spans, gazetteer=table).collect()))
    small = found()
    assert any("plant in Oklahoma" in r for r in small) and any("경기도 소재 공장" in r for r in small)
    monkeypatch.setattr(places, "GAZETTEER_BYTES", 0)
    assert found() == small


@pytest.mark.parametrize(
    ("value", "lang", "phrase"),
    [
        ("성남시", "ko", "경기도의 한 도시"), ("분당구", "ko", "경기도의 한 자치구"), ("성남시 강남구", "ko", "한 자치구"), ("서울", "ko", None), ("새내군", "ko", "한 군 지역"), ("새내군에서 사과 농사", "ko", None), ("성남시에서", "ko", "경기도의 한 도시"),
        ("Tulsa", "en", "a city in Oklahoma"), ("Tulsa, OK", "en", "a city in Oklahoma"), ("Springfield, IL", "en", "a city in Illinois"), ("the Tulsa plant", "en", None), ("France", "en", "a country in Europe"), ("Nowhere", "en", None), ("", "en", None),
    ],
)
def test_phrases(value, lang, phrase):
    assert GAZETTEER.phrase(value, lang) == phrase


def test_consistency():
    assert GAZETTEER.consistent("성남시", "경기도의 한 도시") and not GAZETTEER.consistent("성남시", "서울의 한 도시")
    assert not GAZETTEER.consistent("Nowhere", "a town in Texas") and GAZETTEER.consistent("Nowhere", "a town")


@pytest.mark.parametrize(
    ("text", "value", "said", "new", "phrase", "outcome"),
    [
        ("I'm 34 and tired", "34", "age", "34", "in my 30s", "fixed"), ("I'm 34 and tired", "34", "in my 30s", "34", "in my 30s", "unchanged"), ("she is 34 years old", "34", "", "34 years old", "in her 30s", "fixed"), ("I turned 52", "52", "", "turned 52", "am in my 50s", "fixed"),
        ("a 34-year-old woman", "34-year-old", "x", "34-year-old", "30-something", "fixed"), ("aged 41, he left", "41", "", "aged 41", "in their 40s", "fixed"), ("저는 만 34세입니다", "34세", "", "만 34세", "30대", "fixed"), ("저는 34살입니다", "34", "", "34살", "30대", "fixed"),
        ("it weighs 34 kg", "34", "x", "34", "x", "unchanged"), ("34세대가 산다", "34", "x", "34", "x", "rejected"), ("born in 1992 there", "1992", "", "1992", "the 1990s", "fixed"), ("1992년생입니다", "1992", "", "1992년생", "1990년대생", "fixed"),
        ("DOB: 1992-03-04", "1992-03-04", "", "1992-03-04", "the 1990s", "fixed"), ("생년월일: 1992-03-04", "1992-03-04", "", "1992-03-04", "1990년대", "fixed"), ("on 1992-03-04 someone", "1992-03-04", "in their 40s", "1992-03-04", "in their 30s", "fixed"),
        ("a clerk, aged 34, with twins", "a clerk, aged 34, with twins", "a 35-44 year old", "a clerk, aged 34, with twins", "a 30-39 year old", "fixed"), ("성남시에서 일한다", "성남시", "서울", "성남시", "경기도의 한 도시", "fixed"), ("the Tulsa plant", "Tulsa plant", "a plant in Texas", "Tulsa plant", "a plant in Texas", "rejected"),
        ("우울증 진단", "우울증", "depression", "우울증", "depression", "rejected"),
    ],
)
def test_fixed(text, value, said, new, phrase, outcome):
    i = text.index(value)
    slot, got = fitting.fixed(fitting.Slot(text, i, i + len(value), said), date(2026, 1, 1), GAZETTEER)
    assert (slot.value, slot.replacement, got) == (new, phrase, outcome)


def test_fixed_health():
    slot, got = fitting.fixed(fitting.Slot("우울증 진단", 0, 3, "depression", "HEALTH"), date(2026, 1, 1), None)
    assert (slot.replacement, got) == ("우울장애", "fixed")


@settings(max_examples=200, deadline=None)
@given(st.integers(10, 99), st.sampled_from(["in their {}s", "{}-something", "{}대", "a {}-{} year old"]), st.integers(1, 9))
def test_what_is_said_after_fixing_holds(age, form, said):
    text = f"the clerk with twins, aged {age}, at the plant {'이다' if '대' in form else ''}"
    phrase = form.format(said * 10, said * 10 + 4)
    slot, _ = fitting.fixed(fitting.Slot(text, 4, 33, phrase), date(2026, 1, 1))
    assert all(a <= age <= b for a, b in fitting.stated_ranges(slot.replacement))


def test_repeats_and_pronouns():
    assert fitting.without_repeat("he was born in ", "born in the 1990s") == "the 1990s"
    assert fitting.without_repeat("stubborn in ", "born in the 1990s") == "born in the 1990s"
    assert [fitting.pronoun_before(t) for t in ("my wife is", "I think he is", "it is")] == ["her", "his", "their"]
