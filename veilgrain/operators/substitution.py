"""Substitution: the spans of a conversation's texts, in order, against what the conversation has mapped so far.

A value that is mapped keeps its mapping.  A new one is generalized, if the proposed replacement passes the
checks; becomes a surrogate, if those are asked for and one collides with nothing; or gets the next placeholder of
its type.  Every decision changes what later spans meet, so a conversation is a fold over its requests.  Tables are
folded in sorted partitions, a request in memory at a time (`applied`); streams keep a conversation's mappings in
the state store (`streaming.stores.applied`).  Both run `request_applied`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilgrain.functions.checks import refusal
from veilgrain.functions.normalize import Searched, normalize
from veilgrain.functions.surrogate import fitted_particle, surrogate
from veilgrain.operators.requests import ARTICLE_HEAD, DETERMINER
from veilgrain.operators.spans import ACTIONS, SOURCES, TRUSTED_RULES

SURROGATES = ("PERSON", "ORG", "CONTACT", "ID_NUMBER", "FINANCIAL", "LOCATION")  # fixed value: types that have them
BY_MODEL_OR_RULE = ("llm", "rule")
PARTICLE_CHARS = 4


@dataclass(frozen=True)
class Options:
    """level: minimal keeps quasi-identifiers of models and rules, strict masks what would be generalized; a key
    turns surrogates on."""

    level: str = "balanced"
    surrogate_key: bytes | None = None


@dataclass(frozen=True)
class Mapping:
    original: str
    type: str
    action: str  # mask, generalize or surrogate
    value: str  # the placeholder's name, or what stands in for the original

    @property
    def shown(self) -> str:
        return f"<{self.value}>" if self.action == "mask" else self.value


@dataclass
class Session:
    """What a conversation has mapped, by identity of the original; `fresh` are mappings of this run."""

    conversation: str
    mappings: dict[str, Mapping] = field(default_factory=dict)
    last: dict[str, int] = field(default_factory=dict)
    fresh: list[Mapping] = field(default_factory=list)

    def remember(self, m: Mapping) -> None:
        self.mappings.setdefault(normalize(m.original), m)
        number = m.value.rpartition("_")[2]
        if m.action == "mask" and number.isdigit():
            self.last[m.type] = max(self.last.get(m.type, 0), int(number))

    def add(self, original: str, kind: str, action: str, value: str | None = None) -> Mapping:
        m = Mapping(original, kind, action, value if value is not None else f"{kind}_{self.last.get(kind, 0) + 1}")
        self.remember(m)
        self.fresh.append(m)
        return m


@dataclass(frozen=True)
class Span:
    """start is null for a span that stands for every place of its text."""

    text: str
    type: str
    action: str = "mask"
    source: str = "llm"
    rule: str | None = None
    replacement: str | None = None
    start: int | None = None
    end: int | None = None


@dataclass(frozen=True)
class Slot:
    text: str
    spans: tuple[Span, ...] = ()
    in_json: bool = False


@dataclass
class Applied:
    text: str
    places: list[tuple]  # the fields of PLACES
    detections: list[tuple[str, str, str, str]]  # text, type, action, source
    protected: list[tuple[str, str]]  # text, type: what the gate must not find
    refused: int  # generalizations that the checks refused


def under(level: str, span: Span) -> str:
    """A span's action under a protection level."""
    if span.source in BY_MODEL_OR_RULE:
        if level == "minimal" and span.type == "QUASI_IDENTIFIER":
            return "keep"
        if level == "strict" and span.action == "generalize":
            return "mask"
    return span.action


def _is_key(text: str, start: int, end: int) -> bool:
    """A place is an object's key in JSON text."""
    before, after = text[:start], text[end:]
    return before.endswith('"') and before[:-1].rstrip()[-1:] in ("{", ",", "") and bool(re.match(r'"\s*:', after))


def _rank(order: tuple[str, ...], value: str) -> int:
    return order.index(value) if value in order else 9


def _chosen(places: list[tuple[int, int, Span, str]]) -> list[tuple[int, int, Span, str]]:
    """Places that don't overlap, the longest first, then by source, action and start; in order."""
    taken: list[tuple[int, int, Span, str]] = []
    for p in sorted(places, key=lambda p: (p[0] - p[1], _rank(SOURCES, p[2].source), _rank(ACTIONS, p[3]), p[0])):
        if p[1] > p[0] and all(p[1] <= t[0] or t[1] <= p[0] for t in taken):
            taken.append(p)
    return sorted(taken, key=itemgetter(0))


def _stand_in(value: str, kind: str, session: Session, texts: list[Searched], originals: list[str], key: bytes) -> str | None:
    """A surrogate that is in none of the request's texts, holds no original, and is no other value's."""
    known = list(session.mappings.values())
    used = {m.value for m in known if m.action == "surrogate"}
    held = [o for o in {*originals, *(m.original for m in known)} if len(o.strip()) >= 2]

    def taken(made: str) -> bool:
        own = Searched(made)
        return any(own.places(o) for o in held) or any(t.places(made) for t in texts)

    return surrogate(value, kind, key, session.conversation, "", held, used, taken)


def _mapping(value: str, span: Span, action: str, session: Session, texts: list[Searched], originals: list[str], in_json: bool, options: Options) -> tuple[Mapping, bool]:
    """(mapping of a value that has none, whether a generalization was refused)."""
    refused = False
    if action == "generalize":
        trusted = (span.rule or "").startswith(TRUSTED_RULES)
        if refusal(value, span.replacement, originals, in_json, trusted) is None:
            return session.add(value, span.type, "generalize", (span.replacement or "").strip()), False
        refused = True
    if options.surrogate_key is not None and span.type in SURROGATES:
        made = _stand_in(value, span.type, session, texts, originals, options.surrogate_key)
        if made is not None:
            return session.add(value, span.type, "surrogate", made), refused
    return session.add(value, span.type, "mask"), refused


def slot_applied(slot: Slot, session: Session, texts: list[Searched], originals: list[str], rejected: frozenset[str], options: Options) -> Applied:
    """One text.  `texts` and `originals` are those of the whole request, `rejected` the identities of values that
    the user kept."""
    text, own = slot.text, Searched(slot.text)
    spans = [(s, under(options.level, s)) for s in slot.spans if normalize(s.text) not in rejected]
    places: list[tuple[int, int, Span, str]] = []
    active: list[Span] = []
    for span, action in spans:
        if action == "keep":
            continue
        at = [(span.start, span.end)] if span.start is not None and span.end is not None else own.places(span.text)
        data = [(a, b) for a, b in at if not (slot.in_json and _is_key(text, a, b))]
        if data or not at:
            active.append(span)
        places += [(a, b, span, action) for a, b in data]

    out: list[str] = []
    size = cursor = refused = 0
    made: list[tuple] = []
    detections: list[tuple[str, str, str, str]] = []
    protected = [(s.text, s.type) for s in active]
    for start, end, span, action in _chosen(places):
        original = text[start:end]
        if normalize(original) in rejected:
            continue
        name = original if span.start is not None else span.text  # a variant belongs to the value it is a variant of
        mapping = session.mappings.get(normalize(original)) or session.mappings.get(normalize(name))
        if mapping is None:
            mapping, no = _mapping(name, span, action, session, texts, originals, slot.in_json, options)
            refused += no
        shown = mapping.shown
        if mapping.action == "generalize" and re.search(DETERMINER, text[:start]):
            shown = re.sub(ARTICLE_HEAD, "", shown, flags=re.IGNORECASE) or shown
        out += [text[cursor:start], shown]
        size += start - cursor
        made.append((start, end, size, size + len(shown), original, mapping.action, mapping.type, shown, span.source, span.rule))
        size, cursor = size + len(shown), end
        if mapping.action != "mask":
            following = text[end : end + PARTICLE_CHARS]
            fitted = fitted_particle(shown, following)
            if fitted != following:  # the particle, which may change its length, goes out with the value
                same = next(k for k in range(len(following) + 1) if fitted.endswith(following[k:]))
                particle = fitted[: len(fitted) - (len(following) - same)]
                out.append(particle)
                size, cursor = size + len(particle), end + same
        detections.append((mapping.original, mapping.type, mapping.action, span.source))
        protected.append((mapping.original, mapping.type))
        if normalize(original) != normalize(mapping.original):
            protected.append((original, mapping.type))
    out.append(text[cursor:])
    detections += [(s.text, s.type, "keep", s.source) for s, action in spans if action == "keep"]
    seen: dict[tuple[str, ...], tuple[str, str, str, str]] = {}
    for d in detections:
        seen.setdefault((normalize(d[0]), *d[1:]), d)
    return Applied("".join(out), made, list(seen.values()), list(dict.fromkeys(protected)), refused)


PLACE = ("start", "end", "out_start", "out_end", "original", "action", "type", "shown", "source", "rule")
PLACES = "array<struct<start:int,end:int,out_start:int,out_end:int,original:string,action:string,type:string,shown:string,source:string,rule:string>>"
DETECTIONS = "array<struct<text:string,type:string,action:string,source:string>>"
MAPPINGS = "array<struct<original:string,type:string,action:string,value:string>>"
PROTECTED = "array<struct<text:string,type:string>>"
RESULT = f"text string, places {PLACES}, detections {DETECTIONS}, protected {PROTECTED}, mapped {MAPPINGS}, refused int"
SPANS = "array<struct<text:string,type:string,action:string,source:string,rule:string,replacement:string,start:int,end:int>>"


def slot_of(row: dict) -> Slot:
    spans = tuple(Span(**{k: v for k, v in s.items() if v is not None or k in ("start", "end")}) for s in row["spans"] or [] if s["text"])
    return Slot(row["text"] or "", spans, bool(row["in_json"]))


def result_of(done: Applied, fresh: list[Mapping]) -> dict:
    named = lambda names, rows: [dict(zip(names, r, strict=True)) for r in rows]
    return {
        "text": done.text,
        "places": named(PLACE, done.places),
        "detections": named(("text", "type", "action", "source"), done.detections),
        "protected": named(("text", "type"), done.protected),
        "mapped": [{"original": m.original, "type": m.type, "action": m.action, "value": m.value} for m in fresh],
        "refused": done.refused,
    }


def request_applied(slots: list[Slot], session: Session, options: Options = Options(), rejected: Iterable[str] = ()) -> list[tuple[Applied, list[Mapping]]]:
    """All texts of one request, in order, each with the mappings that it made."""
    known = frozenset(map(normalize, rejected))
    originals = list(dict.fromkeys(s.text for slot in slots for s in slot.spans if under(options.level, s) != "keep" and normalize(s.text) not in known))
    texts = [Searched(slot.text) for slot in slots] if options.surrogate_key is not None else []
    out = []
    for slot in slots:
        before = len(session.fresh)
        done = slot_applied(slot, session, texts, originals, known, options)
        out.append((done, session.fresh[before:]))
    return out


def rows_applied(rows: list[dict], session: Session, options: Options) -> list[dict]:
    """`request_applied` on the rows (text, spans, in_json, rejected) of one request."""
    rejected = {x for r in rows for x in r["rejected"] or []}
    return [result_of(*done) for done in request_applied([slot_of(r) for r in rows], session, options, rejected)]


def prepared(slots: DataFrame, spans: DataFrame, conversation: str, request: str, slot: str) -> DataFrame:
    """(conversation, request, slot, text, in_json, rejected, spans): `slots` with the spans of each in one array, in
    order.  slots may have in_json (the text is JSON) and rejected (values that the user kept); spans may lack rule,
    replacement, start and end."""
    fields = ("text", "type", "action", "source", "rule", "replacement", "start", "end")
    kind = dict.fromkeys(fields, "string") | {"start": "int", "end": "int"}
    given = [(F.col(c) if c in spans.columns else F.lit(None)).cast(kind[c]).alias(c) for c in fields]
    keys = [conversation, request, slot]
    order = F.struct(F.coalesce(F.col("start"), F.lit(-1)) if "start" in spans.columns else F.lit(-1), F.lower("text"))
    grouped = spans.select(*keys, F.struct(order.alias("order"), F.struct(*given).alias("span")).alias("s")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["span"]).cast(SPANS).alias("spans"))
    extra = {"in_json": F.lit(False), "rejected": F.lit(None).cast("array<string>")}
    whole = slots.select(*keys, "text", *[F.col(c) if c in slots.columns else v.alias(c) for c, v in extra.items()])
    return whole.join(grouped, keys, "left")


def applied(slots: DataFrame, spans: DataFrame, conversation: str = "conv_id", request: str = "turn", slot: str = "slot_no", known: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """(conversation, request, slot, text, places, detections, protected, mapped, refused): each text with its spans
    substituted, what was done, and the mappings that it made.

    slots: (conversation, request, slot, text, in_json, rejected); spans: (conversation, request, slot, text, type,
    action, source, rule, replacement, start, end); `known` has mappings of earlier runs (conversation, original, type,
    action, value).  Requests go in order of `request`, texts in order of `slot`.  A conversation is one task's work,
    whatever its length, but only its mappings and the request at hand are held."""
    kinds = dict(slots.dtypes)
    keys = [conversation, request, slot]
    rows = prepared(slots, spans, *keys).withColumn("_known", F.lit(None).cast(MAPPINGS))
    if known is not None:
        held = known.groupBy(conversation).agg(F.collect_list(F.struct("original", "type", "action", "value")).alias("_known"))
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in (conversation, "_known")]
        rows = rows.unionByName(held.select(conversation, *none, "_known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for name, own in groupby(rows, key=itemgetter(conversation)):
            session = Session(str(name))
            for _, some in groupby(own, key=itemgetter(request)):
                some = list(some)
                for r in some:
                    for m in r["_known"] or []:
                        session.remember(Mapping(**m))
                real = [r for r in some if r["_known"] is None]
                if not real:
                    continue
                done = rows_applied(real, session, options)
                out = [{k: r[k] for k in keys} | d for r, d in zip(real, done, strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    result = StructType.fromDDL(", ".join([*(f"{k} {kinds[k]}" for k in keys), RESULT]))
    arrow = to_arrow_schema(result)
    placed = rows.repartition(conversation).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, result)

