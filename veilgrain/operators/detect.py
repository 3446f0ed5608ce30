"""Detectors with offsets: rules, entropy, terms and disguised values, in Arrow batches.

One pass finds all spans of a batch; a row filter in the JVM leaves out texts that can't hold any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.functions import normalize as norm
from veilgrain.functions import rules

SPANS = "start int, end int, text string, type string, action string, source string, rule string"
_COMPILED = [(r, re.compile(r.pattern, re.IGNORECASE if r.any_case else 0)) for r in rules.RULES]
_TOKEN, _URL, _SEGMENT, _ENV = (re.compile(p) for p in (rules.TOKEN, rules.URL, rules.URL_SEGMENT, rules.ENV_KEY))
_PLACEHOLDER = re.compile(rules.PLACEHOLDER)
_DIGIT = re.compile(r"\d")
# Lines of digits, and cues of what they are.
_DIGIT_LINE = re.compile(r"(?m)^[ \t]*(?P<number>\d[\d \t.\-]{1,24}\d)[ \t]*$")
_CARD_CUE = re.compile(r"카드|card|결제|payment", re.IGNORECASE)
_ACCOUNT_CUE = re.compile(r"계좌|account|acct|iban|송금|이체", re.IGNORECASE)
_ID_CUE = re.compile(r"주민|등록번호|외국인등록|resident|national id|ssn", re.IGNORECASE)

Found = tuple[int, int, str, str, str, str, str]


def luhn_ok(value: str) -> bool:
    d = [int(c) for c in value if "0" <= c <= "9"][::-1]
    return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def rrn_ok(value: str) -> bool:
    d = re.sub(r"\D", "", value)
    return bool(re.fullmatch(r"\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[1-8]\d{6}", d))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def secret_like(t: str) -> bool:
    if len(t) < rules.TOKEN_LENGTH or not re.search("[A-Za-z]", t) or not re.search(r"\d", t):
        return False
    plain = re.fullmatch(r"[0-9a-fA-F\-]+|[a-z_\-]+\d*|[A-Z_\-]+\d*", t)
    return not plain and entropy(t) >= rules.ENTROPY_FROM


def _account(v: str) -> bool:
    n = len(re.sub(r"\D", "", v))
    return 10 <= n <= 16 and not re.fullmatch(r"01[016789]-?\d{3,4}-?\d{4}|0\d{1,2}-\d{3,4}-\d{4}", v) and not rrn_ok(v)


def _ticket(v: str) -> bool:
    prefix = v.split("-")[0]
    return prefix not in rules.PUBLIC_PREFIXES and not prefix.isdigit()


def _password(v: str) -> bool:
    v = v.rstrip(".,!?)")
    return bool(re.search("[A-Za-z]", v) and re.search(r"[\d\W_]", v)) and not re.search("[가-힣]", v)


CHECKS = {
    "": lambda v: True,
    "card": luhn_ok,
    "rrn": rrn_ok,
    "account": _account,
    "ticket": _ticket,
    "password": _password,
    "code": lambda v: bool(re.search(r"\d", v)) and not re.fullmatch(r"(?:19|20)\d{2}", v),
    "mixed": lambda v: bool(re.search(r"\d", v) and re.search("[A-Za-z]", v)),
}


def rule_spans(text: str, strict_only: bool = False) -> list[Found]:
    """Spans of the rules and of high-entropy tokens, outside placeholders."""
    out: list[Found] = []
    taken = [m.span() for m in _PLACEHOLDER.finditer(text)]

    def add(start: int, end: int, kind: str, source: str, rule: str) -> None:
        if not any(a <= start and end <= b for a, b in taken):
            out.append((start, end, text[start:end], kind, "mask", source, rule))

    low = text.lower()
    numbers = bool(_DIGIT.search(text))
    for rule, pattern in _COMPILED:
        if strict_only and not rule.strict or rule.cues and not any(numbers if c == "0" else c in low for c in rule.cues):
            continue
        for m in pattern.finditer(text):
            group = rule.group if rule.group >= 0 else next((i for i in range(1, (pattern.groups or 0) + 1) if m[i]), 0)
            if m[group] and CHECKS[rule.check](m[group]):
                add(*m.span(group), rule.kind, "regex", rule.name)
    if strict_only:
        return out
    for url in _URL.finditer(text):
        for m in _SEGMENT.finditer(url[0]):
            if secret_like(m[0]):
                add(url.start() + m.start(), url.start() + m.end(), "SECRET", "entropy", "url_path_token")
    for m in _TOKEN.finditer(text):
        key = _ENV.match(m[0])
        skip = key.end() if key and len(m[0]) - key.end() >= rules.KEY_REST else 0
        if secret_like(m[0][skip:]):
            add(m.start() + skip, m.end(), "SECRET", "entropy", "entropy")
    return out


def number_over_lines(text: str, view: norm.View) -> list[Found]:
    """Cards, accounts and ID numbers that are written over lines of digits, one below the other."""
    out: list[Found] = []
    held: list[re.Match[str]] = []

    def close() -> None:
        digits = re.sub(r"\D", "", "".join(m["number"] for m in held))
        kind = (
            ("ID_NUMBER", "split_rrn") if len(digits) == 13 and rrn_ok(digits) and _ID_CUE.search(text)
            else ("FINANCIAL", "split_card") if 13 <= len(digits) <= 19 and (luhn_ok(digits) or _CARD_CUE.search(text))
            else ("FINANCIAL", "split_account") if 10 <= len(digits) <= 16 and _ACCOUNT_CUE.search(text)
            else None
        )
        if len(held) > 1 and kind:
            start, end = view.raw(held[0].start("number"), held[-1].end("number"))
            out.append((start, end, text[start:end], kind[0], "mask", "regex", kind[1]))

    for m in _DIGIT_LINE.finditer(view.text):
        if held and m.start() != held[-1].end() + 1:
            close()
            held = []
        held.append(m)
    close()
    return out


def hidden_spans(text: str) -> list[Found]:
    """Values that the rules can't see as written: disguised ones, found in the text as its reader sees it, and
    numbers over several lines."""
    changed = norm.may_hide(text)
    if not changed and not ("\n" in text and _DIGIT_LINE.search(text)):
        return []
    view = norm.detection_view(text)
    out = number_over_lines(text, view)
    if view.text == text:
        return out
    for start, end, value, kind, action, source, rule in rule_spans(view.text):
        a, b = view.raw(start, end)
        if source == "regex" and text[a:b] != value:
            out.append((a, b, text[a:b], kind, action, "regex", f"normalized:{rule}"))
    return out


def term_spans(text: str, terms: Iterable[tuple[str, str]]) -> list[Found]:
    return [(a, b, text[a:b], kind, "mask", "vault", "term") for term, kind in terms for a, b in norm.find_term(text, term)]


def detected(df: DataFrame, text: str, *keys: str, terms: tuple[tuple[str, str], ...] = (), hidden: bool = True, strict_only: bool = False) -> DataFrame:
    """(keys, start, end, text, type, action, source, rule) of all spans.  `terms` are declared (term, type)
    pairs, a small list given by the caller; null texts have no spans."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), SPANS])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[Found] = []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                found = rule_spans(t, strict_only) + (hidden_spans(t) if hidden else []) + term_spans(t, terms)
                rows += found
                at += [i] * len(found)
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            columns = [pa.array([r[k] for r in rows], pa.int32() if k < 2 else pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([*own, *columns], names)

    useful = df.where(F.col(text).isNotNull())
    if not terms and not hidden:
        useful = useful.where(F.rlike(F.col(text), F.lit(r"[0-9@:=/]|KEY|Bearer|phrase|words")))
    return useful.select(*keys, text).mapInArrow(run, schema)


def layers(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, layer) of what is decoded from a text, two levels deep."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "layer string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [norm.decoded_layers([t]) for t in batch.column(len(keys)).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array([x for f in found for x in f], pa.string())], [*keys, "layer"])

    return df.where(F.col(text).isNotNull()).select(*keys, text).mapInArrow(run, schema)


def viewed(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, view): a text as its reader sees it, which is what detectors look at besides the text as written."""
    kinds, n = dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [None if t is None else norm.detection_view(t).text if norm.may_hide(t) else t for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(seen, pa.string())], [*keys, "view"])

    return df.select(*keys, text).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "view string"]))
