"""JSON columns with places: leaves, readable and canonical forms, and restoring inside bodies, in Arrow batches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.functions import jsonplaces
from veilgrain.functions.restoring import Restorer

KINDS = ("text", "arguments", "response")


def _mapped(df: DataFrame, column: str, keys: tuple[str, ...], out: str, make: Callable[[str], list[tuple]], types: list[pa.DataType]) -> DataFrame:
    """(keys, out): rows that `make` gives for each value of a column; null values give none."""
    kinds, n = dict(df.dtypes), len(keys)
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(n).to_pylist()):
                made = [] if text is None else make(text)
                at += [i] * len(made)
                rows += made
            own = batch.select(list(range(n))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], [*keys, *names])

    return df.select(*keys, column).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), out]))


def pointer(path: tuple[str | int, ...]) -> str:
    """A path as one string, in the notation of JSON pointers."""
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in path)


def leaves(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, path, kind, start, end, value) of every key, string, number and word of a JSON column, in offsets of its
    text.  What isn't JSON is one string, all of it."""

    def found(text: str) -> list[tuple]:
        own = jsonplaces.leaves(text)
        return [("", "text", 0, len(text), text)] if own is None else [(pointer(x.path), x.kind, x.start, x.end, x.value) for x in own]

    return _mapped(df, column, keys, "path string, kind string, start int, end int, value string", found, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()])


def readable(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, column) with escaped characters of JSON objects and arrays shown, so that detectors can read them."""
    return _mapped(df, column, keys, f"{column} string", lambda t: [(jsonplaces.readable(t),)], [pa.string()])


def canonical(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, canonical, hash): one form for all ways to write the same JSON, and its SHA-256; null for other texts."""

    def form(text: str) -> list[tuple]:
        own = jsonplaces.canonical(text)
        return [(own, None if own is None else hashlib.sha256(own.encode("utf-8", "surrogatepass")).hexdigest())]

    return _mapped(df, column, keys, "canonical string, hash string", form, [pa.string(), pa.string()])


def string_chars(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, chars): characters of all string values of a JSON column, which is what a user controls of a request."""
    count = lambda t: [(sum(len(x.value) for x in jsonplaces.leaves(t) or [] if x.kind == "string"),)]
    return _mapped(df, column, keys, "chars int", count, [pa.int32()])


def restored(rows: DataFrame, mappings: DataFrame, conversation: str, column: str, *keys: str, kind: str = "text", reasoning: bool = False) -> DataFrame:
    """(conversation, keys, column) with the originals of `mappings` (conversation, original, type, action, value) in
    place of placeholders and surrogates.  `kind`: the column holds plain texts, JSON arguments of calls, or whole
    answers of a model.  A conversation's mappings travel as one array."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    kinds = dict(rows.dtypes)
    known = mappings.groupBy(conversation).agg(F.collect_set(F.struct("original", "type", "action", "value")).alias("_known"))
    names = [conversation, *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, restorer = None, Restorer([])
        for batch in batches:
            out = []
            for own, text, held in zip(*[batch.column(c).to_pylist() for c in (conversation, column, "_known")], strict=True):
                if text is None or (held is None and kind != "response"):  # an answer loses its reasoning even where nothing is mapped
                    out.append(text)
                    continue
                if name is None or name != (own,):
                    name, restorer = (own,), Restorer([(m["original"], m["type"], m["action"], m["value"]) for m in held or []])
                out.append(restorer.whole(text) if kind == "text" else restorer.arguments(text) if kind == "arguments" else restorer.response(text, reasoning))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, column])

    joined = rows.select(*names, column).join(known, conversation, "left")
    return joined.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in names), f"{column} string"]))


def _slots(body: str) -> tuple[list[tuple[int, str, str, bool]], list[str]]:
    """((number, path, text, whether it is JSON), ...) of a request's texts in message order, and kinds of contents that
    can't be looked into."""
    found = jsonplaces.leaves(body)
    texts = {x.path: x.value for x in found or [] if x.kind == "string"}
    try:
        messages = json.loads(body).get("messages") if found else None
    except (ValueError, RecursionError, AttributeError):
        messages = None
    slots: list[tuple[tuple, bool]] = []
    unseen: list[str] = []
    for i, message in enumerate(messages if isinstance(messages, list) else []):
        at = ("messages", i)
        if not isinstance(message, dict):
            continue
        content = message.get("content")
        if isinstance(content, str):
            slots.append(((*at, "content"), False))
        for j, part in enumerate(content if isinstance(content, list) else []):
            if isinstance(part, dict):
                if part.get("type") == "text" and isinstance(part.get("text"), str):
                    slots.append(((*at, "content", j, "text"), False))
                else:
                    unseen.append(f"uninspectable_content:{part.get('type')}")
        calls = message.get("tool_calls")
        slots += [((*at, "tool_calls", j, "function", "arguments"), True) for j in range(len(calls) if isinstance(calls, list) else 0)]
        slots.append(((*at, "function_call", "arguments"), True))
    held = [(path, in_json) for path, in_json in slots if path in texts]
    return [(n, pointer(path), texts[path], in_json) for n, (path, in_json) in enumerate(held)], unseen


def request_slots(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """(keys, slot_no, path, text, in_json): the texts of requests in message order: contents, their text parts, and
    arguments of calls, which are JSON themselves.  A body that is no JSON object, or has no messages, has none."""
    return _mapped(df, body, keys, "slot_no int, path string, text string, in_json boolean", lambda t: _slots(t)[0], [pa.int32(), pa.string(), pa.string(), pa.bool_()])


def uninspected(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """(keys, reason) of content parts that aren't text, so that nothing can be found in them."""
    return _mapped(df, body, keys, "reason string", lambda t: [(r,) for r in _slots(t)[1]], [pa.string()])


def _conversation(body: str) -> str | None:
    try:
        whole = json.loads(body)
    except (ValueError, RecursionError):
        return None
    messages = whole.get("messages") if isinstance(whole, dict) else None
    first = next((m for m in messages or [] if isinstance(m, dict) and m.get("role") == "user"), None) if isinstance(messages, list) else None
    raw = json.dumps(messages, sort_keys=True) if first is None else json.dumps(first.get("content"), ensure_ascii=False, sort_keys=True)
    return "conv_" + hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()[:24]


def conversation_ids(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """(keys, conversation): an id from the first message of a user, whatever its content is, or from all messages where
    there is none; null for what isn't JSON."""
    return _mapped(df, body, keys, "conversation string", lambda t: [(_conversation(t),)], [pa.string()])


def projected(df: DataFrame, body: str, known: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, body) with only the known members of JSON objects, as they were written; other texts as they are."""
    only = lambda t: [(jsonplaces.without(t, lambda p: len(p) == 1 and p[0] not in known),)]
    return _mapped(df, body, keys, f"{body} string", only, [pa.string()])
