"""Proposals, shapes, Korean names and roles, linking of parts."""

import pytest

from veilgrain.functions import korean, linking
from veilgrain.functions.regions import Gazetteer
from veilgrain.operators import proposals, requests, semantic

FUNCTION = linking.function_finder(requests.FUNCTIONS)
PLACES = Gazetteer([("성남", "경기도", None), ("판교", "경기도", None), ("Tulsa", "Oklahoma", None)])


@pytest.mark.parametrize(
    ("value", "kind", "expected"),
    [
        ("Dr. Jane Doe's", "PERSON", ("Jane Doe", "PERSON", "trimmed")), ("김민수 과장님이", "PERSON", ("김민수", "PERSON", "trimmed")), ("정다은", "PERSON", ("정다은", "PERSON", "ok")), ("실업급여", "PERSON", (None, "shape", "dropped")), ("장영실이", "PERSON", (None, "figure", "dropped")),
        ("Agent 40071", "PERSON", (None, "shape", "dropped")), ("DB_USER: b3JkZXJzX3J3", "SECRET", ("b3JkZXJzX3J3", "SECRET", "trimmed")), ("비밀번호", "SECRET", (None, "shape", "dropped")), ("orders_rw", "PERSON", (None, "code", "dropped")), ("invoice #A-1234", "ID_NUMBER", ("A-1234", "ID_NUMBER", "trimmed")),
        ("박성훈", "ID_NUMBER", ("박성훈", "PERSON", "retyped")), ("Q4MGD7UBTYHL", "FINANCIAL", ("Q4MGD7UBTYHL", "ID_NUMBER", "retyped")), ("010-1234-5678", "ORG", ("010-1234-5678", "CONTACT", "retyped")), ("acme", "ORG", (None, "shape", "dropped")), ("새론물류에서", "ORG", ("새론물류", "ORG", "trimmed")),
        ("새론이", "ORG", ("새론이", "ORG", "ok")), ("jane", "CONTACT", (None, "shape", "dropped")), ("jane_d", "CONTACT", ("jane_d", "CONTACT", "ok")), ("Jane Doe", "CONTACT", ("Jane Doe", "PERSON", "retyped")), ("a@b.co", "PERSON", ("a@b.co", "CONTACT", "retyped")), ("x", "ORG", (None, "short", "dropped")), ("left-handed", "QUASI_IDENTIFIER", ("left-handed", "QUASI_IDENTIFIER", "ok")),
    ],
)
def test_shaped(value, kind, expected):
    assert proposals.shaped(value, kind, f"see {value} here") == expected


def test_code_and_swallowing():
    assert proposals.code_identifier("redisUrl", "SECRET", "redisUrl: 'x'") and not proposals.code_identifier("redisUrl", "SECRET", "the redisUrl value")
    assert proposals.code_identifier("app_rw", "CONTACT", "role app_rw") and not proposals.code_identifier("app_rw", "CONTACT", "write app_rw")
    long = "word " * 30
    assert proposals.shaped(long, "ORG", long)[2] == "dropped"


def test_candidates_join_choose_and_judge():
    t = "I met Jane Park, of Bright Co. in Paris (34). 독고새론 <PERSON_1>\nAnn\nBo"
    found = proposals.candidates(t, [(6, 10, "first_name", 0.9), (11, 16, "last_name", 0.7), (20, 30, "company_name", 0.6), (20, 26, "city", 0.5), (34, 39, "city", 0.8), (41, 43, "employee_id", 0.9), (46, 50, "password", 0.6), (51, 61, "first_name", 0.9), (62, 65, "first_name", 0.9), (66, 68, "first_name", 0.8), (0, 1, "planet", 1.0), (5, 900, "city", 1.0)])
    assert [(t[c.start : c.end], c.type, c.score, c.verdict) for c in found] == [
        ("Jane Park", "PERSON", 0.7, "ok"), ("Bright Co", "ORG", 0.6, "ok"), ("Paris", "LOCATION", 0.8, "ok"), ("34", "ID_NUMBER", 0.9, "mislabeled"), ("독고새론", "PERSON", 0.6, "renamed"), ("Ann", "PERSON", 0.9, "ok"), ("Bo", "PERSON", 0.8, "ok"),
    ]


@pytest.mark.parametrize(("shape", "good", "bad"), [("pin", "1234", "12"), ("phone", "555-123-4567", "12-3"), ("swift", "DEUTDEFF", "deutdeff"), ("email", "a@b", "a b@c"), ("handle", "@jane_d", "12345"), ("postcode", "06236", "Main 12345678901"), ("birthdate", "3월", "May"), ("address", "12 Main", "Main"), ("place", "Paris", "paris"), ("secret", "hunter22!x", "api-key"), ("account", "110-234-567890", "12"), ("id", "AB-1234-C", "AB"), ("name", "Jane van", "Jane")])
def test_shapes(shape, good, bad):
    if shape == "name":
        good, bad = bad, good
    assert proposals.SHAPES[shape](good) and not proposals.SHAPES[shape](bad)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("김민수 과장이 왔다", ["김민수"]), ("박하은입니다", ["박하은"]), ("이름: 정민준", ["정민준"]), ("독고새론님께", ["독고새론"]), ("김대리님", []), ("자격증님", []), ("이번 과장", []), ("장영실씨는", []), ("예금주 강채원은", ["강채원"]), ("민수가 왔다", []), ("남궁민수 대표님과 선우다온 팀장", ["남궁민수", "선우다온"]), ("이서님", ["이서"]), ("이서 과장", []),
    ],
)
def test_names(text, names):
    found = korean.Names({"이번"}).spans(text)
    assert [text[f.start : f.end] for f in found] == names


@pytest.mark.parametrize(
    ("text", "phrase"),
    [
        ("회사에서 유일한 여성 개발자인데", "유일한 여성 개발자"), ("유일한 방법은 의사를", None), ("단 한 명뿐인 한국 국적의 직원이었고", "단 한 명뿐인 한국 국적의 직원"), ("유일하게 통역사로 일하는", "유일하게 통역사"), ("유일한, 의사", None), ("유일한 이 동네 저 동네 그 의사", None), ("혼자만 외국인이라서", "혼자만 외국인"),
    ],
)
def test_unique_roles(text, phrase):
    assert [text[f.start : f.end] for f in korean.unique_roles(text)] == ([phrase] if phrase else [])


def test_endings_walk_all_particles():
    assert list(korean.ENDINGS.stems("부사장인데")) == ["부사장인데", "부사장"]
    assert list(korean.ENDINGS.stems("회사에서는", 2)) == ["회사에서는", "회사", "회사에서"]
    assert korean.public_figure("이순신이라고") and not korean.public_figure("이순")
    assert korean.Names().plausible("박 성훈") and not korean.Names().plausible("고용보험") and korean.Names().plausible("김철수 이영희")


def test_korean_spans_are_found_as_read_at_raw_places(spark):
    df = spark.createDataFrame([(1, "담당자 김 민 수님, <PERSON_1>님"), (2, "plain"), (3, None), (4, "김민수님")], "id int, text string")
    out = sorted((r.id, r.start, r.text, r.rule) for r in semantic.korean_spans(df, "text", "id").collect())
    assert (4, 0, "김민수", "ko_honorific_name") in out and any(r[0] == 1 and r[2] == "김 민 수" for r in out) and all(r[0] in (1, 4) for r in out)


def links(text, known=False, orgs=()):
    return [(text[a:b], phrase) for a, b, phrase, _ in linking.linked(text, known, list(orgs), FUNCTION, PLACES)]


def test_parts_count_in_company():
    assert links("Our Legal Department is here.") == [] and links("Our Legal Department is here.", True) == [("Legal Department", "legal department")]
    assert links("The Data Platform, Senior Project Architect") == [("Data Platform", "engineering team"), ("Senior Project Architect", "an architect")]
    assert links("The Data Platform. Some Senior Project Architect") == [("Data Platform", "engineering team"), ("Senior Project Architect", "an architect")]  # a role within reach
    assert links("The Data Platform is far away today. Some Senior Project Architect") == []
    assert links("He turned 34 at the Tulsa plant.") == [("turned 34", "in their 30s"), ("Tulsa plant", "plant in Oklahoma")]
    assert links("A Senior Project Architect", True) == [("A Senior Project Architect", "an architect")]
    assert links("the Corvenna site, a Senior Project Architect", False, [4]) == [("Corvenna site", "site"), ("a Senior Project Architect", "an architect")]
    assert links("The whole team won.", True) == [] and links("Google Platform", True) == []
    assert links("Tulsa plant store manager") == [("Tulsa plant store manager", "a manager in a plant in Oklahoma")]


def test_korean_parts():
    assert links("영업2팀 팀장이 왔다") == [("영업2팀 팀장", "영업 부서 관리자")]
    assert links("우리팀 팀장이 왔다") == []
    assert links("판교지사에서 마흔다섯 살인", True) == [("판교지사", "경기도 소재 지사"), ("마흔다섯 살", "40대")]
    assert links("성남 공장", True) == [("성남 공장", "경기도 소재 공장")] and links("새론 공장", True) == []


def test_health_terms_sums_and_relevance(spark):
    from pyspark.sql import functions as F

    from veilgrain.functions import generalize
    from veilgrain.operators import quasi

    patterns = (semantic.KO_HEALTH, semantic.EN_HEALTH)
    rows = [("HER2-positive", True), ("요추 추간판탈출증", True), ("Fabry disease", True), ("자격증", False), ("the only diabetes patient", False), ("ADHD", True), ("a house", False), ("", False), ("case 12345 syndrome", False), ("(Crohn's disease).", True)]
    df = spark.createDataFrame(rows, "v string, e boolean")
    assert [r.v for r in df.select("v", "e", generalize.diagnosis_term(F.col("v"), patterns).alias("d")).collect() if r.d != r.e] == []
    rows = [("도수치료", True), ("Fabry disease", True), ("my knee", False), ("one two three four five", False)]
    df = spark.createDataFrame(rows, "v string, e boolean")
    assert [r.v for r in df.select("v", "e", generalize.health_term(F.col("v")).alias("d")).collect() if r.d != r.e] == []
    rows = [("Is 479001600 equal to 12 factorial?", "479001600", True), ("account 479001600 equals", "479001600", False), ("call 479001600 now", "479001600", False), ("compute 12 + 3", "12", False)]
    df = spark.createDataFrame([(t, t.index(v), t.index(v) + len(v), e) for t, v, e in rows], "t string, a int, b int, e boolean")
    assert [r.t for r in df.select("t", "e", generalize.arithmetic_number(F.col("t"), F.col("a"), F.col("b")).alias("d")).collect() if r.d != r.e] == []
    df = spark.createDataFrame([("I was born on 1990-01-02.", 14, 24, True), ("due on 1990-01-02", 7, 17, False)], "t string, a int, b int, e boolean")
    assert all(r.d == r.e for r in df.select("e", generalize.is_birth_date(F.col("t"), F.col("a"), F.col("b")).alias("d")).collect())
    texts = spark.createDataFrame([(1, "A nurse asks about nurses shifts and nurse pay", ), (2, "A twin asks about taxes",)], "id int, t string")
    attrs = spark.createDataFrame([(1, 2, 7, "role"), (2, 2, 6, "rare")], "id int, start int, end int, category string")
    assert {r.id: r.relevant for r in quasi.relevant(texts, "t", attrs, "id").collect()} == {1: True, 2: False}


@pytest.mark.parametrize(
    ("value", "kind", "kept"),
    [
        ("$46,500", "FINANCIAL", True), ("월 소득 290만원", "FINANCIAL", True), ("90 days overdue, $46,500", "FINANCIAL", True), ("account 1234, $5", "FINANCIAL", False), ("Jane Doe owes $5", "FINANCIAL", True), ("Jane Doe owes us all $5", "FINANCIAL", False), ("4111 1111", "FINANCIAL", False), ("2024-03-05", "ID_NUMBER", True), ("AB-1234", "ID_NUMBER", False), ("5 mg/day", "HEALTH", True), ("HbA1c 7.9", "HEALTH", True),
        ("7시, 11시, 15시", "ID_NUMBER", True), ("8:30 a.m.", "FINANCIAL", True), ("three weeks", "QUASI_IDENTIFIER", True), ("3월 5일", "QUASI_IDENTIFIER", True), ("March 5th, 2024", "QUASI_IDENTIFIER", True), ("12 people", "QUASI_IDENTIFIER", False), ("", "HEALTH", False),
    ],
)
def test_situation_values(spark, value, kind, kept):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(value, kind)], "v string, k string")
    assert df.select(semantic.situation_kept(F.col("v"), F.col("k")).alias("x")).first().x is kept
