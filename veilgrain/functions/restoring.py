"""Restoring of originals, in whole texts, in streams of chunks, and inside JSON.

What stands for an original is looked for with one pattern: placeholders in any bracket style, or bare, and
surrogates as written or spaced otherwise, with their parts.  The same pattern, matched partially, says where the
end of a text may still become a match, so a stream holds back exactly that and nothing else: any way of cutting a
text into chunks gives the text that restoring the whole gives."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import regex

from veilgrain.functions import jsonplaces
from veilgrain.functions.normalize import normalize
from veilgrain.functions.surrogate import fitted_particle

# Brackets and names of placeholders, the wording that asks for the last digits, fields of an answer.
OPENERS = ("&lt;", "<", "＜", "⟨", "〈", "《", "[[", "[", "［［", "［", "⟦", "{{", "｛｛")
CLOSERS = ("&gt;", ">", "＞", "⟩", "〉", "》", "]]", "]", "］］", "］", "⟧", "}}", "｝｝")
NAME, BARE = "[A-Za-zＡ-Ｚａ-ｚ][A-Za-zＡ-Ｚａ-ｚ_＿]{0,60}[_＿][0-9０-９]{1,9}", r"[A-Z][A-Z_]{0,60}_[0-9]{1,9}"
LAST_DIGITS = regex.compile(
    r"(?i)(?:last\s*(?:4|four)(?:\s*digits)?|ending\s+(?:in|with)|ends\s+(?:in|with)|끝\s*자리|뒷\s*자리|뒤\s*4\s*자리|마지막\s*4\s*자리)"
    r"(?:[\s:*()\[\]\-–—,_`'\"]|only|number|no\.|is|are|of|번호|는|은|가|이){0,12}$"
)
DIGIT_TYPES = ("FINANCIAL", "ID_NUMBER")
REASONING, SPOKEN = ("reasoning_content", "reasoning"), ("content", "refusal")
BLANKS, CUE_CHARS, PARTICLE_CHARS, LEAST_PART, LEAST_LONG = 8, 48, 4, 3, 12


def parts(shown: str, original: str, kind: str) -> list[tuple[str, str]]:
    """Pieces of a surrogate that stand for pieces of its original: a name's last and first word, an organization
    without the words that both end with."""
    ours, theirs = shown.split(), original.split()
    if kind == "PERSON" and len(ours) == len(theirs) >= 2:
        return [(a, b) for a, b in ((ours[-1], theirs[-1]), (ours[0], theirs[0])) if len(a) >= LEAST_PART]
    if kind == "ORG":
        n = 0
        while n < min(len(ours), len(theirs)) - 1 and ours[-1 - n] == theirs[-1 - n]:
            n += 1
        stem = " ".join(ours[: len(ours) - n])
        if n and len(stem) >= (LEAST_PART if regex.search("[가-힣]", stem) else LEAST_PART + 1):
            return [(stem, " ".join(theirs[: len(theirs) - n]))]
    return []


def _literal(text: str) -> str:
    """Any case, any blanks (up to BLANKS) between words, Latin ends being ends of words."""
    edge = lambda c: bool(regex.match("[A-Za-z0-9_]", c))
    body = rf"\s{{1,{BLANKS}}}".join(map(regex.escape, text.split()))
    return (r"(?<![A-Za-z0-9_])" if edge(text[0]) else "") + body + (r"(?![A-Za-z0-9_])" if edge(text[-1]) else "")


@dataclass
class Held:
    """Where a stream is: text that waits, the character before it, and the end of what went out."""

    waiting: str = ""
    before: str = ""
    released: str = ""


class Restorer:
    """Originals by what stands for them: `mappings` are (original, type, action, value)."""

    def __init__(self, mappings: Iterable[tuple[str, str, str, str]]):
        mappings = list(mappings)
        self.keys = {value: original for original, _, action, value in mappings if action == "mask"}
        stand = [(value.strip(), original, kind) for original, kind, action, value in mappings if action == "surrogate" and value.strip()]
        self.aliases: dict[str, str] = {}
        for shown, original, _ in stand:
            self.aliases.setdefault(normalize(shown), original)
        for shown, original, kind in stand:
            for part, own in parts(shown, original, kind):
                self.aliases.setdefault(normalize(part), own)
        known = sorted(self.aliases, key=lambda a: (-len(a), a))
        either = lambda xs: "|".join(map(regex.escape, xs))
        wrapped = rf"(?:{either(OPENERS)})\s{{0,{BLANKS}}}(?P<wrapped>{NAME})\s{{0,{BLANKS}}}(?:{either(CLOSERS)})"
        found = [wrapped, rf"(?<![A-Za-z0-9_])(?P<bare>{BARE})(?![A-Za-z0-9_])", *([f"(?P<alias>(?i:{'|'.join(map(_literal, known))}))"] if known else [])]
        whole = f"(?:{'|'.join(found)})(?P<after>[가-힣]{{0,{PARTICLE_CHARS}}})"
        self.pattern = regex.compile(whole)
        # No text has what this asks for at the end, so it matches partially, wherever the end of a text can be reached.
        self.open_end = regex.compile(whole + "\uffff")

    def _original(self, m: regex.Match, written: str) -> str | None:
        groups = m.groupdict()
        if groups.get("alias"):
            return self.aliases.get(normalize(groups["alias"]))
        key = unicodedata.normalize("NFKC", groups["wrapped"] or groups["bare"]).upper()
        original = self.keys.get(key)
        if original is not None and key.startswith(DIGIT_TYPES) and LAST_DIGITS.search(written[-CUE_CHARS:]):
            digits = "".join(c for c in original if c.isdigit())
            return digits[-4:] if len(digits) >= LEAST_LONG else original
        return original

    def feed(self, held: Held, chunk: str, last: bool = False, in_json: bool = False) -> str:
        """What can go out after a chunk; `held` is changed."""
        text = held.before + held.waiting + chunk
        at, out = len(held.before), []
        written = held.released
        while True:
            m = self.pattern.search(text, at)
            unsure = None if last else self.open_end.search(text, at, partial=True)
            stop = unsure.start() if unsure and unsure.partial else len(text)
            if m is None or stop <= m.start():
                break
            out.append(text[at : m.start()])
            written += out[-1]
            original = self._original(m, written)
            if original is None:  # an unknown name goes out as it is, up to its end
                out.append(text[m.start() : m.start("after")])
                at = m.start("after")
            else:
                shown = json.dumps(original, ensure_ascii=False)[1:-1] if in_json else original
                out += [shown, fitted_particle(original, m["after"])]
                at = m.end()
            written += "".join(out[-1:] if original is None else out[-2:])
        out.append(text[at:stop])
        written += out[-1]
        held.before, held.waiting, held.released = text[max(0, stop - 1) : stop], text[stop:], written[-64:]
        return "".join(out)

    def whole(self, text: str, in_json: bool = False) -> str:
        return self.feed(Held(), text, True, in_json)

    def arguments(self, text: str) -> str:
        """Arguments of a call: JSON with its string values restored, or any other text, restored as inside a string."""
        changed = jsonplaces.rewritten(text, lambda leaf: self.whole(leaf.value))
        return self.whole(text, True) if changed is None else changed

    def response(self, body: str, reasoning: bool = False) -> str:
        """A model's answer with what its messages say, and the arguments of their calls, restored; all else stays as it
        is, but reasoning, which goes unless it is asked for, and blanks that a content begins with."""
        message = lambda path: len(path) > 3 and path[0] == "choices" and path[2] == "message"

        def change(leaf: jsonplaces.Leaf) -> str | None:
            if not message(leaf.path):
                return None
            where = leaf.path[3:]
            if where[-1] == "arguments" and (where[0] == "function_call" or where[:1] == ("tool_calls",) and where[-2] == "function"):
                return self.arguments(leaf.value)
            if where[0] in (*SPOKEN, *REASONING) and (len(where) == 1 or where[0] != "refusal"):
                new = self.whole(leaf.value)
                return new.lstrip() if where == ("content",) else new
            return None

        if not reasoning:
            body = jsonplaces.without(body, lambda path: message(path) and len(path) == 4 and path[3] in REASONING)
        changed = jsonplaces.rewritten(body, change)
        return body if changed is None else changed
