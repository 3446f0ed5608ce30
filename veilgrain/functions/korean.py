"""Korean names and roles: particles taken off by a finite-state walk, names by their shape, roles near a cue."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

# Particles and copulas, roles, titles, surnames, figures, nouns, endings of nouns, wordings of rules.
PARTICLES = (
    "으로부터", "로부터", "에서는", "에게는", "께서는", "이라서", "이라고", "이지만", "입니다", "이에요", "이었고", "이었는데", "으로서", "로서", "에서", "에게", "께서", "한테", "이랑", "하고", "이나", "까지", "부터", "처럼", "같은", "이고", "이며",
    "인데", "이다", "이야", "이라", "였고", "였는데", "라서", "라고", "이어서", "여서", "으로", "이", "가", "은", "는", "을", "를", "의", "께", "과", "와", "도", "만", "랑", "나", "로", "에", "인", "야", "다", "님", "들",
)
ROLES = frozenset(
    """부사장 사장 대표 대표이사 이사 임원 상무 전무 본부장 실장 팀장 파트장 부장 차장 과장 대리 주임 사원 직원 인턴 신입 개발자 엔지니어 디자이너 기획자 마케터 연구원 연구자 과학자 박사 석사 교수 강사 교사 선생님 원장 원감 교장 교감 의사 전문의 한의사 치과의사 수의사 간호사
    약사 간병인 요양보호사 물리치료사 변호사 판사 회계사 세무사 노무사 법무사 변리사 통역사 번역가 기자 작가 피디 아나운서 목사 전도사 신부 수녀 스님 경찰 경찰관 형사 소방관 군인 장교 부사관 병사 여군 공무원 사무관 주무관 조종사 기장 승무원 셰프 요리사 바리스타 운전기사 택시기사 버스기사
    선수 코치 감독 트레이너 매니저 점장 농부 어부 해녀 학생 대학원생 유학생 박사과정 교환학생 여성 남성 여자 남자 외국인 한국인 흑인 백인 동양인 아시아인 장애인 이민자 난민 교포 탈북민 탈북자 귀화인 혼혈 트랜스젠더 동성애자 게이 레즈비언 입주민 주민 세입자 환자 생존자 목격자 증인 창업자
    설립자 소유주 건물주 집주인 쌍둥이 청각장애인 시각장애인 휠체어 사용자 워킹맘 한부모 입양아 노인 회원 멤버 조합원""".split()
)
ROLE_ENDS = ("출신", "국적")
UNIQUE_CUE = re.compile(r"유일한|유일하게|유일무이한|혼자만|단\s*한\s*명(?:뿐인|의|인|뿐)?|하나뿐인")
CLAUSE_END = re.compile(r"[.,!?;:\n()\"“”'‘’]")
TOPIC_END = re.compile(r"[가-힣]{2,}(?:은|는|을|를|에서|에게|에|와|과|으로|이고|이다|인데|이라서|이지만|하고)")
SURNAMES = "김이박최정강조윤장임한오서신권황안송류유전홍고문양손배백허남심노하곽성차주우구민나진지엄채원천방공현함변염여추도석선설마길연위표명기반왕금옥육인맹제모탁국"
LONG_SURNAMES = ("황보", "남궁", "제갈", "선우", "독고", "사공", "서문")
TITLES = "대표님 대표 팀장님 팀장 부장님 부장 과장님 과장 차장님 차장 대리님 대리 사원 실장님 실장 주임님 주임 상무님 상무 전무님 전무 이사님 본부장님 본부장 선생님 교수님 교수 원장님 원장 변호사님 변호사 의사 고객님 고객 환자분 환자 기자님 기자 작가님 작가 간호사님 간호사 약사님 님 씨".split()
TITLE_WORDS = frozenset("대표 팀장 부장 과장 차장 대리 사원 실장 주임 상무 전무 이사 본부장 선생 교수 원장 변호사 의사 고객 환자 기자 작가 간호사 사장 회장 부사장 반장 소장 국장 기사".split())
AFTER_TITLE = "께서는|께서|에게|한테|이랑|하고|이나|이고|이며|인데|입니다|이세요|께|이|가|은|는|을|를|의|과|와|도|만|랑|들|로|에|과의|와의"
NOT_LAST = frozenset("증과층급실팀처청측들분쪽께적형별의사장님군읍면")
NOUN_ENDS = frozenset("법증률액료급처청팀과층측적의님읍면물품량력사직")
FIGURES = frozenset(
    """이순신 세종대왕 장영실 허준 정약용 이황 이이 김구 안중근 유관순 윤봉길 김유신 광개토대왕 신사임당 백종원 손흥민 이강인 김민재 류현진 박찬호 박지성 김연아 이재용 정의선 구광모 최태원 신동빈 방시혁 김범수 이해진 봉준호 박찬욱 유재석 강호동 이재명 윤석열 문재인 박근혜
    이명박 노무현 김대중 김영삼 한강 조수미 정주영 이건희 반기문 조성진 임윤찬 황의조 김하성 이정후 오타니 차범근 홍명보 서장훈""".split()
)
COMMON_NOUNS = frozenset(
    """위로금 위약금 지원금 장려금 성과금 배우자 고용주 노동자 장애인 임대인 임차인 조합원 신청인 신청서 신입생 안내문 서명란 이력서 진단서 소견서 마감일 제출일 지급일 제안서 고지서 고용법 공휴일 하반기 상반기 나머지
    임금 급여 고용 연금 연차 연봉 서명 서류 기한 기간 안건 조건 조항 주소 지역 지급 문서 문의 신고 신청 권리 권한 노조 노무 원금 원고 채권 채무 공제 공고 인사 인원 제출 정산""".split()
)
NAME_LABELS = "이름|성함|성명|담당자|사용자|수신인|수신자|발신인|발신자|예금주|보호자|신청인|작성자|고객명|환자명|받는\\s?분|보내는\\s?분"
INTRODUCED = r"입니다|이에요|예요|이라고\s?합니다|라고\s?합니다"
ROLE_TOKENS, ROLE_CHARS, MOST_PARTICLES = 4, 40, 2
UNIQUE_PHRASE = "특정 역할의 구성원"

_full = lambda given: rf"(?P<name>(?:{'|'.join(LONG_SURNAMES)})[가-힣]{{1,2}}|[{SURNAMES}][가-힣]{given})"
_TITLED = re.compile(rf"(?<![가-힣]){_full('{1,3}?')}(?P<gap>\s?)(?P<title>{'|'.join(TITLES)})(?=(?:{AFTER_TITLE})?(?![가-힣]))")
_LABELED = re.compile(rf"(?:{NAME_LABELS})\s*(?:은|는|이|가|:|：|=|-)?\s*{_full('{2}')}(?=(?:님|씨|이고|이며|입니다|이에요|예요|이|가|은|는|을|를|의|과|와|도|께|에게|한테)?(?![가-힣]))")
_INTRODUCED = re.compile(rf"(?<![가-힣]){_full('{2}')}(?:{INTRODUCED})")
_TOKEN = re.compile(r"[가-힣A-Za-z0-9][가-힣A-Za-z0-9\-]*")


class Endings:
    """Particles as a trie over their letters from the last one, so all that a word ends in are met in one walk."""

    def __init__(self, particles: tuple[str, ...] = PARTICLES):
        self.root: dict = {}
        for p in particles:
            node = self.root
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = True

    def cuts(self, word: str) -> Iterator[int]:
        """Lengths of `word` without one particle, the longest particle first."""
        node, found = self.root, []
        for k in range(len(word) - 1, 0, -1):
            node = node.get(word[k])
            if node is None:
                break
            if "" in node:
                found.append(k)
        yield from reversed(found)

    def stems(self, word: str, most: int = MOST_PARTICLES) -> Iterator[str]:
        """`word`, then what is left without one particle, without two, and so on."""
        level, seen = [word], {word}
        for _ in range(most + 1):
            yield from level
            level = [w[:k] for w in level for k in self.cuts(w)]
            level = [w for w in dict.fromkeys(level) if w not in seen]
            seen |= set(level)

    def known(self, word: str, holds: Callable[[str], bool]) -> str | None:
        """The first stem for which `holds` is true: as much of the word as can be."""
        return next((s for s in self.stems(word) if holds(s)), None)


ENDINGS = Endings()


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    type: str
    rule: str
    replacement: str | None = None


def _role(token: str) -> str | None:
    """What of a token is a role, without its particles."""
    role = ENDINGS.known(token, ROLES.__contains__)
    if role is not None:
        return role
    if token.startswith(ROLE_ENDS):
        return token
    return ENDINGS.known(token, lambda s: any(s.endswith(e) and len(s) > len(e) for e in ROLE_ENDS))


def unique_roles(text: str) -> list[Found]:
    """From a word for `only` to the last role among the next tokens of the same clause; a noun with a particle that
    isn't a role ends the phrase."""
    out = []
    for cue in UNIQUE_CUE.finditer(text):
        stop = CLAUSE_END.search(text, cue.end(), cue.end() + ROLE_CHARS)
        limit = stop.start() if stop else min(len(text), cue.end() + ROLE_CHARS)
        end = None
        for n, token in enumerate(_TOKEN.finditer(text, cue.end(), limit)):
            if n == ROLE_TOKENS:
                break
            if (role := _role(token[0])) is not None:
                end = token.start() + len(role)
            elif TOPIC_END.fullmatch(token[0]):
                break
        if end is not None:
            out.append(Found(cue.start(), end, "QUASI_IDENTIFIER", "ko_quasi", UNIQUE_PHRASE))
    return out


def public_figure(name: str) -> bool:
    return ENDINGS.known(name.strip(), FIGURES.__contains__) is not None


def noun_shaped(word: str) -> bool:
    """Shaped like a common noun: four syllables without a long surname, an ending of nouns, or a listed noun."""
    return (len(word) == 4 and not word.startswith(LONG_SURNAMES)) or word[-1:] in NOUN_ENDS or word in COMMON_NOUNS


class Names:
    """Names by their shape.  `never` are further words that are no names; what they are depends on the texts."""

    def __init__(self, never: frozenset[str] | set[str] = frozenset()):
        self.never = frozenset(never) | FIGURES

    def word(self, token: str) -> bool:
        """A full name, or a given name of two syllables."""
        if not re.fullmatch("[가-힣]{2,4}", token) or token in self.never or token in TITLE_WORDS or noun_shaped(token):
            return False
        return len(token) == 2 or token.startswith(LONG_SURNAMES) or token[0] in SURNAMES

    def plausible(self, text: str) -> bool:
        """One name, perhaps written apart, or several; titles and particles are off already."""
        t = text.strip()
        if not re.search("[가-힣]", t) or re.search("[A-Za-z0-9]", t):
            return False
        tight = re.sub(r"\s+", "", t)
        return self.word(tight) if 2 <= len(tight) <= 4 else len(t.split()) > 1 and all(map(self.word, t.split()))

    def _titled(self, text: str) -> Iterator[Found]:
        for m in _TITLED.finditer(text):
            name, apart = m["name"], bool(m["gap"])
            if name in self.never or name[-1] in NOT_LAST or name[1:] in TITLE_WORDS or name[2:] in TITLE_WORDS:
                continue
            if len(name) == 2 and (apart or m["title"] not in ("님", "씨")):
                continue  # two syllables and a word may be anything
            if len(name) == 4 and not name.startswith(LONG_SURNAMES):
                continue
            yield Found(m.start("name"), m.end("name"), "PERSON", "ko_honorific_name")

    def _labeled(self, text: str) -> Iterator[Found]:
        for pattern in (_LABELED, _INTRODUCED):
            for m in pattern.finditer(text):
                name = m["name"]
                if name not in self.never and name[-1] not in NOT_LAST and name[1:] not in TITLE_WORDS and name[:2] not in self.never:
                    yield Found(m.start("name"), m.end("name"), "PERSON", "ko_labeled_name")

    def spans(self, text: str) -> list[Found]:
        return [*self._titled(text), *self._labeled(text)]
