"""Stores with expiry: timers without further events, single use, crowding, restarts from a checkpoint."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgrain.operators import substitution
from veilgrain.streaming import state, stores


@pytest.fixture
def played(spark, tmp_path):
    """Runs a stream over batches of rows, one after another; a batch ends a query, and the next one starts anew from its
    checkpoint."""

    def run(batches, schema, make, casts=None):
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, schema)
            for c, f in (casts or {}).items():
                df = df.withColumn(c, f(c))
            df.coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
            stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in/*")
            out = state.run_available(make(stream), f"file://{tmp_path}/run")
        return out.collect()

    return run


AT = {"at": F.to_timestamp}


def test_reviews_expire_and_are_used_once(played):
    rows = [[("a", "2024-01-01 00:00:00", "open"), ("a", "2024-01-01 00:05:00", "use"), ("a", "2024-01-01 00:06:00", "use"), ("b", "2024-01-01 00:00:00", "open")], [("c", "2024-01-01 01:00:00", "open"), ("b", "2024-01-01 01:00:00", "use")], [("z", "2024-01-01 02:00:00", "open")]]
    out = played(rows, "review_id string, at string, kind string", stores.reviews, AT)
    assert sorted((r.review_id, f"{r.at:%H:%M}", r.outcome) for r in out) == [
        ("a", "00:00", "held"), ("a", "00:05", "used"), ("a", "00:06", "unknown"), ("b", "00:00", "held"), ("b", "00:10", "expired"), ("b", "01:00", "unknown"), ("c", "01:00", "held"), ("c", "01:10", "expired"), ("z", "02:00", "held"),
    ]


def test_sessions_live_on_from_each_use(played):
    rows = [[("a", "2024-01-01 00:00:00", "open"), ("a", "2024-01-01 00:20:00", "use"), ("a", "2024-01-01 00:45:00", "use")], [("a", "2024-01-01 01:10:00", "close"), ("b", "2024-01-01 01:10:00", "use")]]
    out = played(rows, "session_id string, at string, kind string", stores.sessions, AT)
    assert sorted((r.session_id, f"{r.at:%H:%M}", r.outcome) for r in out) == [("a", "00:00", "held"), ("a", "00:20", "used"), ("a", "00:45", "used"), ("a", "01:10", "closed"), ("b", "01:10", "unknown")]


def test_least_recently_used_goes_but_never_one_in_flight(played):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [[("a", t(0), "begin"), ("b", t(1), "open"), ("c", t(2), "open")], [("b", t(3), "use"), ("d", t(4), "open"), ("a", t(5), "end")], [("e", t(6), "open"), ("d", t(7), "close"), ("f", t(8), "open")]]
    out = played(rows, "id string, at string, kind string", lambda s: stores.crowded_out(s, "id", "at", "kind", 3), AT)
    assert sorted((f"{r.at:%M}", r.id) for r in out) == [("04", "c"), ("06", "b")]


def test_substitution_goes_on_after_a_restart(played):
    span = lambda *names: [(n, "PERSON", "mask", "rule", None, None, None, None) for n in names]
    schema = f"conv_id string, turn int, slot_no int, text string, in_json boolean, rejected array<string>, spans {substitution.SPANS}"
    rows = [[("c", 1, 0, "Ann", False, None, span("Ann")), ("c", 0, 0, "Bob", False, None, span("Bob"))], [("c", 2, 0, "Ann, Cy", False, ["x"], span("Cy", "Ann")), ("d", 0, 0, "Ann", False, None, span("Ann"))]]
    out = played(rows, schema, stores.applied)
    assert sorted((r.conv_id, r.turn, r.text) for r in out) == [("c", 0, "<PERSON_1>"), ("c", 1, "<PERSON_2>"), ("c", 2, "<PERSON_2>, <PERSON_3>"), ("d", 0, "<PERSON_1>")]


def test_restoring_holds_back_over_batches(played):
    known = [("Ann", "PERSON", "mask", "PERSON_1"), ("Kim Lee", "PERSON", "surrogate", "Alex Marsh")]
    schema = "stream_id string, chunk_no long, text string, last boolean, mappings array<struct<original:string,type:string,action:string,value:string>>"
    rows = [[("s", 0, "Hi <PERS", False, known)], [("s", 1, "ON_1> and Alex", False, None)], [("s", 2, " Marsh", True, None)]]
    out = played(rows, schema, stores.restored)
    assert [r.text for r in sorted(out, key=lambda r: r.chunk_no)] == ["Hi ", "Ann and ", "Kim Lee"]


def test_limiter_keeps_its_window(played):
    rows = [[("k", f"2024-01-01 00:00:{s:02d}", i) for i, s in enumerate((0, 1, 2))], [("k", "2024-01-01 00:00:10", 3), ("k", "2024-01-01 00:00:11", 4)]]
    out = played(rows, "key string, at string, n int", lambda s: stores.admitted(s, "key", "at", "n", 2, 10), AT)
    assert [r.admitted for r in sorted(out, key=lambda r: r.n)] == [True, True, False, True, True]


class _Cell:
    """A state variable or a handle that counts its calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def _called(self, value=None):
        self.calls += 1
        return value

    def __getattr__(self, name):
        if name in ("getValueState", "getMapState"):
            return lambda *_: self
        return {
            "get": lambda: self._called(self.value), "update": lambda v: self._called(setattr(self, "value", v)), "clear": lambda: self._called(setattr(self, "value", None)),
            "registerTimer": lambda t: self._called(self.timers.add(t)), "deleteTimer": lambda t: self._called(self.timers.remove(t)), "updateValue": lambda *_: self._called(),
        }[name]


def test_a_key_asks_the_store_once_for_all_its_rows():
    cell, step = _Cell(), stores._Expiring(("id", "at", "kind"), 600, True, True)
    step.init(cell)
    rows = lambda *xs: [pd.DataFrame([(pd.Timestamp(f"2024-01-01 00:{m:02d}:00"), k) for m, k in xs], columns=["at", "kind"])]
    (out,) = step.handleInputRows(("a",), rows((0, "open"), (1, "use"), (2, "open"), (3, "open")), None)
    assert list(out.outcome) == ["held", "used", "held", "held"] and cell.calls == 3
    assert cell.timers == {int(pd.Timestamp("2024-01-01 00:13:00").value // 1_000_000)}
    (out,) = step.handleInputRows(("a",), rows((20, "use"),), None)
    assert list(out.outcome) == ["expired", "unknown"] and not cell.timers and cell.value is None


def test_an_answer_that_ends_leaves_no_state():
    cell, step = _Cell(), stores._Restoring()
    step.init(cell)
    known = [{"original": "Ann", "type": "PERSON", "action": "mask", "value": "PERSON_1"}]
    given = pd.DataFrame([(0, "Hi <PERS", False, known), (1, "ON_1>", True, None)], columns=["chunk_no", "text", "last", "mappings"])
    (out,) = step.handleInputRows(("s",), [given], None)
    assert "".join(out.text) == "Hi Ann" and cell.value is None and cell.calls == 1
