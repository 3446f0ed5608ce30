"""Linking over tables: whether a conversation has named an organization by then, joined to the texts; within a text,
parts that count by company are found in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.functions import linking
from veilgrain.functions.regions import Gazetteer, Place
from veilgrain.operators import places as place_tables
from veilgrain.operators.requests import FUNCTIONS


def organizations_known(slots: DataFrame, spans: DataFrame, conversation: str, order: str) -> DataFrame:
    """(conversation, order, known, places): for each text whether one of the conversation's texts up to it has a
    masked organization, and where those of its own stand.  One window over flags; texts don't move."""
    masked = spans.where((F.col("type") == "ORG") & (F.col("action") != "keep")).groupBy(conversation, order).agg(F.collect_list(F.col("start").cast("int")).alias("places"))
    flags = slots.select(conversation, order).distinct().join(masked, [conversation, order], "left")
    so_far = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flags.select(conversation, order, F.coalesce(F.max(F.col("places").isNotNull()).over(so_far), F.lit(False)).alias("known"), "places")


class _Asking(Gazetteer):
    """Knows no place, and keeps what it is asked."""

    def __init__(self):
        super().__init__([])
        self.texts: list[str] = []

    def korean(self, text: str) -> list[Place]:
        self.texts.append(text)
        return []

    english = korean


def linked(slots: DataFrame, spans: DataFrame, conversation: str = "conv_id", order: str = "turn", gazetteer: DataFrame | None = None) -> DataFrame:
    """(conversation, order, start, end, text, replacement, rule): quasi-identifiers made of parts of organizations, to
    be generalized.  slots: (conversation, order, text); spans: (conversation, order, start, type, action)."""
    kinds = dict(slots.dtypes)
    known = Gazetteer([]) if gazetteer is None else place_tables.collected(gazetteer)
    names = [conversation, order]
    columns = [*names, "text", "known", "places"]

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = linking.function_finder(FUNCTIONS)
        for batch in batches:
            asked = []
            for text in batch.column("text").to_pylist():
                matcher = _Asking()
                linking.parts(text, function, matcher)
                asked.append("\n".join(matcher.texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(asked, pa.string()), pa.array([""] * len(asked), pa.string())], [*columns, "_v", "_s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = linking.function_finder(FUNCTIONS)
        for batch in batches:
            at, rows = [], []
            matchers = place_tables.of_parts(batch.column("_part")) if known is None else repeat(known, batch.num_rows)
            for i, (text, org, own, matcher) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("text", "known", "places")], matchers, strict=True)):
                found = linking.linked(text, bool(org), own or [], function, matcher)
                at += [i] * len(found)
                rows += [(a, b, text[a:b], phrase, rule) for a, b, phrase, rule in found]
            kept = batch.select(names).take(pa.array(at, pa.int64()))
            made = [pa.array([r[k] for r in rows], pa.int32() if k < 2 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*names, "start", "end", "text", "replacement", "rule"])

    met = slots.where("text is not null").select(*names, "text").join(organizations_known(slots, spans, conversation, order), names).select(*columns)
    if known is None:
        met = place_tables.with_parts(met.mapInArrow(asking, ", ".join([*(f"`{c}` {t}" for c, t in met.dtypes), "_v string, _s string"])), "_v", "_s", gazetteer).select(*columns, "_part")
    return met.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in names), "start int, end int, text string, replacement string, rule string"]))
