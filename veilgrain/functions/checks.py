"""Why a replacement may not stand in for a value."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from veilgrain.functions.normalize import normalize

# Length, characters and particles of replacements, and shapes of placeholders.
MOST_CHARS = 120
_JUNK = re.compile(r"[{}\[\]<>`|\\]")
_PARTICLE = re.compile("(?:으로서|로서|으로|에서|에게|께서|이라서|이라|인데|이고|이며|이다|입니다|이에요|예요|로|이|가|은|는|을|를|의|에|와|과|도|만|인|다)$")
_PLACEHOLDER = re.compile(r"[<＜⟨〈《\[［⟦{｛]\s*[A-Za-z_]+_[0-9]+|[A-Z][A-Z_]*_\d+\s*[>＞⟩〉》\]］⟧}｝]|\[\[|\]\]")
_HANGUL = re.compile("[가-힣]")


def telling_tokens(value: str) -> tuple[set[str], set[str]]:
    """(numbers, words) of a value that would give it away: runs of digits, words of Latin letters that begin with a
    capital, Korean words of three syllables or more, with and without their particle."""
    numbers = set(re.findall(r"\d+", value))
    words: set[str] = set()
    for word in re.findall(r"[0-9A-Za-z가-힣][0-9A-Za-z가-힣'\-]*", value):
        if _HANGUL.search(word):
            parts = re.split("[-']", word)
            words |= {w for part in parts for w in (part, _PARTICLE.sub("", part)) if len(w) >= 3}
        elif len(word) >= 2 and word[0].isupper():
            words.add(word.casefold())
    return numbers, words


def refusal(value: str, replacement: str | None, others: Iterable[str] = (), in_json: bool = False, trusted: bool = False) -> str | None:
    """Why `replacement` may not stand in for `value`; None if it may.

    `others` are further values that it must not hold.  A trusted one was worked out here, not proposed: it may
    share words with the value, but may not be the value or hold one."""
    new = (replacement or "").strip()
    if not new:
        return "empty"
    if len(new) > MOST_CHARS:
        return "long"
    if _PLACEHOLDER.search(new):
        return "placeholder"
    if _JUNK.search(new) or any(unicodedata.category(c) == "Cc" for c in new) or (in_json and any(c in '"\\' for c in new)):
        return "characters"
    own, shown = normalize(value), normalize(new)
    if shown == own or (not trusted and shown in own):
        return "crop"
    if any(held and held in shown for held in map(normalize, (value, *others))):
        return "value"
    if _HANGUL.search(value) and not _HANGUL.search(new):
        return "language"
    if trusted:
        return None
    numbers, words = telling_tokens(value)
    folded = new.casefold()
    if numbers & set(re.findall(r"\d+", new)) or any(w in folded for w in words):
        return "token"
    return None
