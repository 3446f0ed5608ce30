"""Surrogates: believable values in place of originals, and Korean particles that fit them.

A surrogate is chosen by a keyed hash of the original, so it is stable for a key and differs between
keys; numbers use reserved or invalid ranges.  Collisions with the text are avoided by trying again."""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable

# Name and word lists, particle pairs (after a consonant, after a vowel).
FIRST = "Alex Robin Jamie Casey Morgan Taylor Jordan Riley Quinn Avery Rowan Skyler".split()
LAST = "Marsh Calloway Benton Fairfax Holloway Kestrel Lindqvist Mercer Norwood Pemberton Quill Thornton".split()
KO_SURNAMES, KO_GIVEN = "김이박최정강조윤장임", "서준 하윤 도현 지안 시우 예린 민재 수아 건우 다온".split()
ORG_STEMS = "Northmere Brightwell Calderstone Eastvale Harborline Silverbrook".split()
PARTICLES = (
    ("이라고", "라고"), ("이라는", "라는"), ("이라서", "라서"),
    ("이었다", "였다"), ("이었고", "였고"), ("이에요", "예요"),
    ("이랑", "랑"), ("이나", "나"), ("이며", "며"), ("이고", "고"), ("이야", "야"),
    ("으로", "로"), ("과", "와"), ("은", "는"), ("을", "를"), ("이", "가"), ("아", "야"),
)
CONTINUED = ("의", "는", "도", "만", "서", "써", "부터", "")  # what may follow a particle
DIGIT_FINALS = {"0": 21, "1": 8, "3": 16, "6": 1, "7": 8, "8": 8}
ATTEMPTS = 16


class Draw:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.parts, self.n = key, "\0".join(parts), 0

    def below(self, n: int) -> int:
        self.n += 1
        return int.from_bytes(hmac.new(self.key, f"{self.parts}\0{self.n}".encode(), "sha256").digest()[:8], "big") % n

    def pick(self, items):
        return items[self.below(len(items))]

    def digits(self, shape: str) -> str:
        return "".join(str(self.below(10)) if c.isdigit() else c for c in shape)


def _luhn(digits: str) -> bool:
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _made(original: str, kind: str, draw: Draw) -> str | None:
    if kind == "PERSON":
        if re.fullmatch("[가-힣]{2,4}", original):
            return draw.pick(KO_SURNAMES) + draw.pick(KO_GIVEN)
        words = original.split()
        return " ".join([draw.pick(FIRST)] * (len(words) > 1) + [draw.pick(LAST if len(words) > 1 else FIRST)]) if words else None
    if kind == "ORG":
        words = original.split()
        return f"{draw.pick(ORG_STEMS)} {words[-1]}" if len(words) > 1 else None
    if kind == "CONTACT":
        if "@" in original:
            return f"{draw.pick(FIRST).lower()}.{draw.pick(LAST).lower()}@example.com"
        if re.match(r"(?:\+82[ -]?)?0?1[016789]", original.strip()):
            return "010-0" + draw.digits("000-0000")  # no number in use begins with 0 after the prefix
        return "(555) 555-01" + draw.digits("00")
    if kind == "FINANCIAL":
        n = sum(c.isdigit() for c in original)
        shape, keep = draw.digits(original), original[-4:]
        made = shape[:-4] + keep if n >= 12 and keep.isdigit() else shape
        return made if n < 12 or not _luhn(re.sub(r"\D", "", made)) else None
    if kind == "ID_NUMBER":
        made = draw.digits(original)
        if m := re.fullmatch(r"(\d{2})\d{2}(\d{2}-?\d{7})", made):
            return m[1] + str(13 + draw.below(7)) + m[2]  # a month that doesn't exist
        return "666" + made[3:] if re.fullmatch(r"\d{3}-\d{2}-\d{4}", made) else made  # an area never given out
    return None


def collides(made: str, text: str, originals: list[str], used: set[str]) -> bool:
    low = made.casefold()
    return low in text.casefold() or made in used or any(o and o.casefold() in low for o in originals)


def surrogate(original: str, kind: str, key: bytes, conversation: str = "", text: str = "", originals: list[str] | None = None, used: set[str] | None = None, taken: Callable[[str], bool] | None = None) -> str | None:
    """A surrogate for a value, or None where none fits; then a placeholder is used.  `taken` says of a further value
    that it can't be used."""
    for attempt in range(ATTEMPTS):
        made = _made(original.strip(), kind, Draw(key, conversation, kind, original, str(attempt)))
        if made and made != original and not collides(made, text, originals or [original], used or set()) and not (taken and taken(made)):
            return made
    return None


def final_consonant(word: str) -> int | None:
    last = word.rstrip()[-1:]
    if "가" <= last <= "힣":
        return (ord(last) - 0xAC00) % 28
    return DIGIT_FINALS.get(last, 0) if last.isdigit() else None


_FORMS = {form: pair for pair in reversed(PARTICLES) for form in pair}  # of a form that two pairs have, the earlier one
_PARTICLE = re.compile(rf"({'|'.join(sorted(_FORMS, key=len, reverse=True))})(?:{'|'.join(filter(None, CONTINUED))})?(?![가-힣])")


def fitted_particle(word: str, following: str) -> str:
    """`following` with the particle at its beginning as `word` asks for it."""
    final = final_consonant(word)
    if final is None or not (m := _PARTICLE.match(following)):
        return following
    consonant, vowel = _FORMS[m[1]]
    plain = final in (0, 8) if consonant == "으로" else final == 0
    return (vowel if plain else consonant) + following[m.end(1) :]
