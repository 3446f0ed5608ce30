"""Stores with expiry, as stateful streams: mappings of conversations, hits of a limiter, reviews, sessions.

Every key's state is typed (values, lists and maps of Spark's state store), so a step reads and writes only what it
needs.  What expires does so by timers, without a further event of its key.  Within a batch a key's rows are taken in
the order of their own time, never of arrival.

A limit on all keys together (the least recently used of more than `most` goes) is a second step with one key that
holds ids and times alone, at most `most` and the ones that came since; it is as small as the limit."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilgrain.functions.restoring import Held, Restorer
from veilgrain.operators import substitution

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ready(df: DataFrame) -> DataFrame:
    """Typed state needs the RocksDB store; sets it where the session names none."""
    conf = df.sparkSession.conf
    if "RocksDB" not in conf.get(PROVIDER[0], ""):
        conf.set(*PROVIDER)
    return df


def ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> list[dict[str, Any]]:
    """A key's rows of a batch as records, in order."""
    held = [f for f in frames if len(f)]
    return pd.concat(held).sort_values(by, kind="stable").to_dict("records") if held else []


def millis(at: Any) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class _Limiter(StatefulProcessor):
    """Admitted hits of a key, as a list of times that only holds the window."""

    def __init__(self, key: str, at: str, tie: str, limit: int, seconds: int):
        self.key, self.at, self.tie, self.limit, self.span = key, at, tie, limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [t for (t,) in self.hits.get()] if self.hits.exists() else []
        out = []
        for r in ordered(rows, [self.at, self.tie]):
            now = int(pd.Timestamp(r[self.at]).value // 1000)
            held = [t for t in held if now - t < self.span]
            if ok := len(held) < self.limit:
                held.append(now)
            out.append((key[0], r[self.tie], ok))
        if held:
            self.hits.put([(t,) for t in held])
        else:
            self.hits.clear()
        yield pd.DataFrame(out, columns=[self.key, self.tie, "admitted"])

    def close(self) -> None:
        pass


def admitted(events: DataFrame, key: str, at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """(key, tie, admitted): a sliding limiter in which only admitted hits count; a key's state is `limit` times at most."""
    kinds = dict(events.dtypes)
    step = _Limiter(key, at, tie, limit, seconds)
    return ready(events).groupBy(key).transformWithStateInPandas(step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, admitted boolean", "Append", "None")


class _Numbers(StatefulProcessor):
    """A conversation's values and the last number of each type, each an entry of a map."""

    def __init__(self, conversation: str, order: tuple[str, ...]):
        self.conversation, self.order = conversation, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "norm string", "type string, number long")
        self.last = handle.getMapState("last", "type string", "number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in ordered(rows, list(self.order)):
            if not self.known.containsKey((r["norm"],)):
                kind = r["type"]
                number = (self.last.getValue((kind,))[0] if self.last.containsKey((kind,)) else 0) + 1
                self.last.updateValue((kind,), (number,))
                self.known.updateValue((r["norm"],), (kind, number))
                out.append((key[0], r["norm"], kind, number, f"<{kind}_{number}>"))
        yield pd.DataFrame(out, columns=[self.conversation, "norm", "type", "number", "placeholder"])

    def close(self) -> None:
        pass


def numbered(values: DataFrame, conversation: str = "conv_id", order: tuple[str, ...] = ("turn", "start")) -> DataFrame:
    """(conversation, norm, type, number, placeholder) of values not seen before in their conversation.

    `values` is a stream of (conversation, order columns, type, norm).  Numbers go on from the state; a value keeps
    the type of its first mapping."""
    schema = f"{conversation} {dict(values.dtypes)[conversation]}, norm string, type string, number long, placeholder string"
    return ready(values).groupBy(conversation).transformWithStateInPandas(_Numbers(conversation, order), schema, "Append", "None")


class _Substitution(StatefulProcessor):
    def __init__(self, keys: list[str], options: substitution.Options):
        self.keys, self.options = keys, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mappings = handle.getMapState("mappings", "norm string", "original string, type string, action string, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        conversation, request, slot = self.keys
        session = substitution.Session(str(key[0]))
        for _, m in self.mappings.iterator():
            session.remember(substitution.Mapping(*m))
        given = ordered(rows, [request, slot])
        out = []
        while given:
            n = next((i for i, r in enumerate(given) if r[request] != given[0][request]), len(given))
            some, given = given[:n], given[n:]
            plain = [{"text": r["text"], "in_json": r["in_json"], "rejected": _list(r["rejected"]), "spans": [_span(s) for s in _list(r["spans"])]} for r in some]
            out += [{k: r[k] for k in self.keys} | done for r, done in zip(some, substitution.rows_applied(plain, session, self.options), strict=True)]
        for m in session.fresh:
            self.mappings.updateValue((substitution.normalize(m.original),), (m.original, m.type, m.action, m.value))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _list(value: Any) -> list:
    return [] if value is None or isinstance(value, float) else list(value)


def _span(value: Any) -> dict[str, Any]:
    s = value.asDict() if hasattr(value, "asDict") else dict(value)
    return {k: (None if v is None or v != v else int(v) if k in ("start", "end") else v) for k, v in s.items()}


def applied(slots: DataFrame, conversation: str = "conv_id", request: str = "turn", slot: str = "slot_no", options: substitution.Options = substitution.Options()) -> DataFrame:
    """`substitution.applied` on a stream of slots that carry their spans (conversation, request, slot, text, in_json,
    rejected, spans); a conversation's mappings are in the state, so later batches go on where earlier ones ended."""
    kinds = dict(slots.dtypes)
    keys = [conversation, request, slot]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), substitution.RESULT])
    return ready(slots).groupBy(conversation).transformWithStateInPandas(_Substitution(keys, options), schema, "Append", "None")


class _Restoring(StatefulProcessor):
    """The mappings that a stream's chunks brought, and where the stream is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mappings = handle.getMapState("mappings", "norm string", "original string, type string, action string, value string")
        self.place = handle.getValueState("place", "waiting string, before string, released string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = ordered(rows, ["chunk_no"])
        place = self.place.get()
        known = {k[0]: m for k, m in self.mappings.iterator()} if place else {}
        brought = {}
        for r in given:
            for m in _list(r["mappings"]):
                m = _span(m)
                brought[substitution.normalize(m["original"])] = tuple(m[c] for c in ("original", "type", "action", "value"))
        restorer = Restorer((known | brought).values())
        held = Held(*place) if place else Held()
        out = [(key[0], r["chunk_no"], restorer.feed(held, r["text"] or "", bool(r["last"]))) for r in given]
        if given and given[-1]["last"]:  # nothing follows, so nothing is kept
            if place:
                self.mappings.clear()
                self.place.clear()
        else:
            for k, m in brought.items():
                self.mappings.updateValue((k,), m)
            self.place.update((held.waiting, held.before, held.released))
        yield pd.DataFrame(out, columns=["stream_id", "chunk_no", "text"])

    def close(self) -> None:
        pass


def restored(chunks: DataFrame) -> DataFrame:
    """(stream_id, chunk_no, text) of a stream of answer chunks (stream_id, chunk_no, text, last, mappings array of
    original, type, action, value): what can go out after each.  All mappings of a stream have to be there with its first
    chunk; an end that may still become a placeholder or a surrogate waits, and the last chunk lets it go."""
    schema = f"stream_id {dict(chunks.dtypes)['stream_id']}, chunk_no long, text string"
    return ready(chunks).groupBy("stream_id").transformWithStateInPandas(_Restoring(), schema, "Append", "None")


class _Expiring(StatefulProcessor):
    """One thing a key, open since `opened` and due at `due`; a timer ends it."""

    def __init__(self, columns: tuple[str, str, str], seconds: int, single: bool, event_time: bool):
        self.columns, self.wait, self.single, self.event_time = columns, seconds * 1000, single, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name, at, kind = self.columns
        found = self.due.get()  # a call to the store costs more than a row, so the state is read once and written once
        due = before = found[0] if found else None
        out = []
        for r in ordered(rows, [at]):
            now = millis(r[at]) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            live = due is not None and now < due
            if due is not None and not live:
                out.append((key[0], pd.Timestamp(due, unit="ms"), "expired"))
                due = None
            if r[kind] == "open":
                out.append((key[0], r[at], "held"))
                due = now + self.wait
            elif r[kind] == "close":
                out.append((key[0], r[at], "closed" if live else "unknown"))
                due = None
            elif live:
                out.append((key[0], r[at], "used"))
                due = None if self.single else now + self.wait
            else:
                out.append((key[0], r[at], "unknown"))
        if due != before:
            if before is not None:  # a key's only timer is the one at its due time
                self.handle.deleteTimer(before)
            if due is None:
                self.due.clear()
            else:
                self.due.update((due,))
                self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=[name, at, "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        name, stamp, _ = self.columns
        due = self.due.get()
        if due and due[0] <= at:
            self.due.clear()
            yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), "expired")], columns=[name, stamp, "outcome"])
        else:
            yield pd.DataFrame([], columns=[name, stamp, "outcome"])

    def close(self) -> None:
        pass


def expiring(events: DataFrame, key: str, at: str, kind: str, seconds: int, single: bool, late: str = "0 seconds", event_time: bool = True) -> DataFrame:
    """(key, at, outcome) of a stream of (key, at, kind: open, use or close): `held` when it opens, `used` while it is
    live, `unknown` where nothing is, `closed`, and `expired`, once, `seconds` after it opened, stamped with that time,
    also if no further event of the key comes.  A single one is gone after its use; another lives on from each use."""
    kinds = dict(events.dtypes)
    stream = ready(events)
    if event_time:
        stream = stream.withWatermark(at, late)
    step = _Expiring((key, at, kind), seconds, single, event_time)
    schema = f"{key} {kinds[key]}, {at} timestamp, outcome string"
    return stream.groupBy(key).transformWithStateInPandas(step, schema, "Append", "EventTime" if event_time else "ProcessingTime")


def reviews(events: DataFrame, seconds: int = 600, late: str = "0 seconds") -> DataFrame:
    """Reviews (review_id, at, kind) wait `seconds` for their one use."""
    return expiring(events, "review_id", "at", "kind", seconds, True, late)


def sessions(events: DataFrame, seconds: int = 1800, late: str = "0 seconds") -> DataFrame:
    """Sessions (session_id, at, kind) live `seconds` after their last use."""
    return expiring(events, "session_id", "at", "kind", seconds, False, late)


class _Recent(StatefulProcessor):
    """The ids in use, with the time of their last use and the number of requests in flight."""

    def __init__(self, name: str, at: str, kind: str, most: int):
        self.name, self.at, self.kind, self.most = name, at, kind, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "at long, busy long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: (v[0], v[1]) for k, v in self.seen.iterator()}
        before = dict(held)
        out = []
        for r in ordered(rows, [self.at, self.name]):
            name, now = r[self.name], millis(r[self.at])
            _, busy = held.pop(name, (now, 0))
            if r[self.kind] == "close":
                continue
            held[name] = (now, max(0, busy + {"begin": 1, "end": -1}.get(r[self.kind], 0)))
            if len(held) > self.most:
                free = [(t, k) for k, (t, b) in held.items() if not b and k != name]
                if free:
                    gone = min(free)[1]
                    del held[gone]
                    out.append((gone, r[self.at]))
        for k in before.keys() - held.keys():
            self.seen.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.seen.updateValue((k,), v)
        yield pd.DataFrame(out, columns=[self.name, self.at])

    def close(self) -> None:
        pass


def crowded_out(events: DataFrame, key: str, at: str, kind: str, most: int = 256) -> DataFrame:
    """(key, at): what has to go for others, when more than `most` are open: the least recently used one that isn't in
    flight (`begin` without `end`).  Nothing goes while all are.  One task decides for all keys, on ids and times."""
    ids = events.select(F.lit(0).alias("_all"), F.col(key).cast("string").alias(key), at, kind)
    return ready(ids).groupBy("_all").transformWithStateInPandas(_Recent(key, at, kind, most), f"{key} string, {at} timestamp", "Append", "None")


