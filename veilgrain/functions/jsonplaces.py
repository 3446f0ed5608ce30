"""JSON text with places: every value and key knows where it stands, so a text can be changed in one string and stay
as it was, byte for byte, everywhere else.  Nesting may be of any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<blank>[ \t\n\r]+)|(?P<mark>[{}\[\],:])|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")"""
    r"""|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.])|(?P<word>true|false|null)(?!\w)"""
)
_ESCAPE = re.compile(r"\\(?:u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)")
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_LEAST = {v: f"\\{k}" for k, v in _SHORT.items()} | {'"': '\\"', "\\": "\\\\"}
_MUST = re.compile(r'["\\\x00-\x1f\ud800-\udfff]')


class Leaf(NamedTuple):
    """A string, number, word (true, false, null) or key at [start, end) of the text, quotes included.  `path` has an
    object's keys and an array's indexes; a key's path is that of its value."""

    kind: str
    path: tuple[str | int, ...]
    start: int
    end: int
    raw: str

    @property
    def value(self) -> str:
        """A string or key unescaped, anything else as written."""
        return unescaped(self.raw[1:-1]) if self.kind in ("string", "key") else self.raw


def unescaped(body: str) -> str:
    def plain(m: re.Match[str]) -> str:
        e = m[0]
        if e[1] != "u":
            return _SHORT.get(e[1], e[1])
        return chr(int(e[2:6], 16)) if len(e) == 6 else chr(0x10000 + ((int(e[2:6], 16) - 0xD800) << 10) + int(e[8:12], 16) - 0xDC00)

    return _ESCAPE.sub(plain, body) if "\\" in body else body


def escaped(value: str) -> str:
    """Only what must be escaped is."""
    return _MUST.sub(lambda m: _LEAST.get(m[0]) or f"\\u{ord(m[0]):04x}", value)


def tokens(text: str) -> list[Leaf] | None:
    """All leaves and brackets (kind `mark`) of a JSON text in order; None if it isn't one."""
    out: list[Leaf] = []
    path: list[str | int] = []
    open_in: list[str] = []  # brackets around the place
    state = "value"  # value, first (value or end of an array), key, begin (key or end of an object), colon, after
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at, kind, raw = m.end(), m.lastgroup, m[0]
        if kind == "blank":
            continue
        if state in ("key", "begin") and kind == "string":
            path[-1] = unescaped(raw[1:-1])
            out.append(Leaf("key", tuple(path), m.start(), at, raw))
            state = "colon"
        elif state == "colon" and raw == ":":
            state = "value"
        elif state in ("value", "first") and raw in ("{", "["):
            out.append(Leaf("mark", tuple(path), m.start(), at, raw))
            open_in.append(raw)
            path.append("" if raw == "{" else 0)
            state = "begin" if raw == "{" else "first"
        elif state in ("value", "first") and kind in ("string", "number", "word"):
            out.append(Leaf(kind, tuple(path), m.start(), at, raw))
            state = "after"
        elif open_in and raw == ("}" if open_in[-1] == "{" else "]") and state in ("after", "begin" if open_in[-1] == "{" else "first"):
            open_in.pop()
            path.pop()
            out.append(Leaf("mark", tuple(path), m.start(), at, raw))
            state = "after"
        elif state == "after" and open_in and raw == ",":
            if open_in[-1] == "[":
                path[-1] += 1
            state = "key" if open_in[-1] == "{" else "value"
        else:
            return None
    return out if state == "after" and not open_in else None


def leaves(text: str) -> list[Leaf] | None:
    found = tokens(text)
    return None if found is None else [x for x in found if x.kind != "mark"]


def rewritten(text: str, change: Callable[[Leaf], str | None]) -> str | None:
    """The text with each string value for which `change` gives another one in its place; None if it isn't JSON."""
    found = leaves(text)
    if found is None:
        return None
    out, at = [], 0
    for leaf in found:
        if leaf.kind == "string" and (new := change(leaf)) is not None and new != leaf.value:
            out += [text[at : leaf.start], '"', escaped(new), '"']
            at = leaf.end
    return "".join([*out, text[at:]])


def readable(text: str) -> str:
    """A JSON object or array whose `\\uXXXX` escapes are characters, where they may be; other texts as they are."""
    if text.lstrip()[:1] not in ("{", "[") or "\\u" not in text or (found := leaves(text)) is None:
        return text
    out, at = [], 0
    for leaf in found:
        if leaf.kind in ("string", "key") and "\\u" in leaf.raw:
            shown = _ESCAPE.sub(lambda m: m[0] if m[0][1] != "u" else escaped(unescaped(m[0])), leaf.raw)
            out += [text[at : leaf.start], shown]
            at = leaf.end
    return "".join([*out, text[at:]])


def number_form(raw: str) -> str:
    """Whole numbers as they are, but for a minus before zero; others in the shortest form that gives the same double."""
    if not re.search("[.eE]", raw):
        return "0" if raw == "-0" else raw
    value = float(raw)
    return "null" if value in (float("inf"), float("-inf")) else json.dumps(value)


def canonical(text: str) -> str | None:
    """The same JSON with sorted keys, of repeated ones the last, no blanks, and one form for each string and number;
    None if the text isn't JSON."""
    found = tokens(text)
    if found is None:
        return None
    stack: list[tuple[str, list[str], dict[str, str]]] = [("", [], {})]
    keys: list[str] = []

    def put(value: str) -> None:
        kind, items, fields = stack[-1]
        if kind == "{":
            fields[keys.pop()] = value
        else:
            items.append(value)

    for t in found:
        if t.kind == "key":
            keys.append(t.value)
        elif t.kind == "string":
            put(f'"{escaped(t.value)}"')
        elif t.kind != "mark":
            put(number_form(t.raw) if t.kind == "number" else t.raw)
        elif t.raw in "{[":
            stack.append((t.raw, [], {}))
        else:
            kind, items, fields = stack.pop()
            put("[" + ",".join(items) + "]" if kind == "[" else "{" + ",".join(f'"{escaped(k)}":{fields[k]}' for k in sorted(fields)) + "}")
    return stack[0][1][0]


def without(text: str, drop: Callable[[tuple[str | int, ...]], bool]) -> str:
    """The text without the members of objects whose path `drop` names; other texts than JSON as they are."""
    found = tokens(text) or []
    out, at, skip = [], 0, 0
    for i, t in enumerate(found):
        if t.kind != "key" or t.start < skip or not drop(t.path):
            continue
        end, depth = i + 1, 0
        while True:  # the member's value ends where its own brackets do
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(found[end].raw, 0) if found[end].kind == "mark" else 0
            if depth == 0:
                break
            end += 1
        begin, skip = t.start, found[end].end
        rest = len(text) - len(text[skip:].lstrip(" \t\n\r"))
        if text[rest : rest + 1] == ",":
            skip = len(text) - len(text[rest + 1 :].lstrip(" \t\n\r"))
        else:
            head = "".join([*out, text[at:begin]]).rstrip(" \t\n\r")
            if head.endswith(","):  # the last member goes with the comma before it
                out, at, begin = [head[:-1]], begin, begin
        out.append(text[at:begin])
        at = skip
    return "".join([*out, text[at:]])
