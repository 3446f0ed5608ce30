"""Named institutions, school classes and small groups: who someone is by where they belong, with coarser phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from veilgrain.functions.linking import KO_AFTER

# Kinds with their phrases, words that are no names, numbers in words.
KO_KINDS = {k: f"한 {k}" for k in "보건의료원 보건지소 보건소 의료원 교회 성당 초등학교 중학교 고등학교 분교 유치원 어린이집 파출소 지구대 경찰서 소방서 우체국 주민센터 도서관 복지관 요양원 아파트 빌라 오피스텔 부대".split()} | {"성결교회": "한 교회", "함": "한 함정", "처": "한 정부 기관"}
KO_NO_NAMES = frozenset(
    """우리 저희 동네 근처 인근 옆 이 그 저 한 여러 같은 다른 해당 모든 새 큰 작은 대형 소형 시립 국립 공립 사립 도립 군립 구립 지역 지방 임대 주공 행복주택 신축 구축 고급 오래된 거래 연락 근무 출 대 판매 사용 접수 문의 처리 보관 해결 거주 소속 담당 방문 공공 초등 중 고등 사회복지 노인 요양 어린이
    전체 일반 주변 가까운 유명한 서울 부산 대구 인천 광주 대전 울산 세종 경기 강원 충북 충남 전북 전남 경북 경남 제주 해군 육군 공군 해병대 군 국방 포 기 합 조 전 특수""".split()
)
EN_KINDS = {
    "High School": "a high school", "High": "a high school", "Elementary School": "an elementary school", "Elementary": "an elementary school", "Middle School": "a middle school", "Academy": "a school", "Church": "a church", "Medical Center": "a hospital",
    "Hospital": "a hospital", "Clinic": "a clinic", "Library": "a library", "Precinct": "a precinct", "Air Force Base": "a military base", "Base": "a military base", "Apartments": "an apartment complex",
}
EN_NO_NAMES = frozenset("The A An Our My Their Your His Her This That Every Each Local Public Private State National Community Regional General Children's Harvard Stanford Yale Princeton Mayo Cleveland Johns".split())
NUMBERS = {w: n for n, w in enumerate("two three four five six seven eight nine ten eleven twelve".split(), 2)}
GROUPS = {
    "a local board": ("commission", "board", "council"), "a small business": ("company", "firm", "brewery", "startup", "restaurant", "shop", "store", "bakery", "agency"), "a medical practice": ("practice", "clinic"), "a congregation": ("church", "congregation"),
    "a committee": ("committee",), "a nonprofit": ("nonprofit",), "a small school": ("school",), "a small team": ("team", "office", "department", "unit", "lab", "crew", "squad", "band"),
}
LARGE = 100  # people, from which on a group says little
_either = lambda words: "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
_OF_GROUP = {kind: phrase for phrase, kinds in GROUPS.items() for kind in kinds}
_KO_CLASS = re.compile(r"(?<!\d)(?P<grade>\d{1,2}\s?학년)\s?\d{1,2}\s?반(?![가-힣])")
_KO_NAMED = re.compile(rf"(?<![가-힣A-Za-z0-9])(?P<name>[가-힣A-Za-z0-9]{{2,10}}?)(?P<gap>\s?)(?P<kind>{_either(KO_KINDS)}){KO_AFTER}")
_KO_COUNT = re.compile(r"(?<![가-힣])(?:직원|팀원|구성원|회원|교인|학생|부원)\s?(?P<n>\d{1,3})\s?명")
_EN_GROUP = re.compile(rf"\b(?P<n>\d{{1,3}}|{_either(NUMBERS)})-(?:member|person|people|employee|staff|student|bed|seat)[ \t]+(?:[a-z][a-z\-]*[ \t]+){{0,2}}?(?P<kind>{_either(_OF_GROUP)})\b")
_CAP = r"[A-Z][\w'’\-]*"
_EN_NAMED = re.compile(
    rf"(?P<name>(?:{_CAP}[ \t]){{1,3}})(?P<kind>{_either(EN_KINDS)})\b|(?P<camp>\b(?:Camp|Fort)[ \t][A-Z][a-z]+\b)"
    r"|(?P<unit>\b\d+(?:st|nd|rd|th)[ \t](?:[A-Z][a-z]+[ \t]){0,3}(?:Company|Battalion|Squadron|Brigade|Regiment|Wing|Platoon)\b)"
)


class Institution(NamedTuple):
    start: int
    end: int
    rule: str
    phrase: str


def _named_korean(text: str) -> Iterator[Institution]:
    for m in _KO_NAMED.finditer(text):
        name, apart, kind = m["name"], bool(m["gap"]), m["kind"]
        if name in KO_NO_NAMES or name.isdigit() or (kind == "아파트" and name.endswith(("주공", "임대"))):
            continue
        if apart and name[-1] in "은는이가을를의에도서로와과께":
            continue  # a word with its particle, not a name
        if kind in ("함", "처", "부대") and (apart or len(name) < 3):
            continue
        yield Institution(m.start(), m.end("kind"), "ko_institution", KO_KINDS[kind])


def _named_english(text: str) -> Iterator[Institution]:
    for m in _EN_NAMED.finditer(text):
        if m["camp"] or m["unit"]:
            yield Institution(m.start(), m.end(), "en_institution", "a military base" if m["camp"] else "a military unit")
            continue
        words = [(w.start(), w[0]) for w in re.finditer(r"\S+", m["name"])]
        own = next((at for at, w in words if w not in EN_NO_NAMES), None)
        if own is not None:
            yield Institution(m.start("name") + own, m.end("kind"), "en_institution", EN_KINDS[m["kind"]])


def institutions(text: str) -> list[Institution]:
    """All of them, in order of the rules; they may overlap."""
    found = [Institution(m.start(), m.end(), "ko_school_class", m["grade"]) for m in _KO_CLASS.finditer(text)]
    found += _named_korean(text)
    for m in _KO_COUNT.finditer(text):
        if (n := int(m["n"])) < LARGE:
            found.append(Institution(m.start("n"), m.end(), "ko_headcount", "10명 미만" if n < 10 else f"{n // 10 * 10}여 명"))
    for m in _EN_GROUP.finditer(text):
        if (int(m["n"]) if m["n"].isdigit() else NUMBERS[m["n"].lower()]) < LARGE:
            found.append(Institution(m.start(), m.end(), "en_small_group", _OF_GROUP[m["kind"]]))
    return [*found, *_named_english(text)]
