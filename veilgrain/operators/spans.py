"""Span algebra: spans are rows (slot_id, start, end, type, action, source, rule, text) or arrays of
structs; offsets count code points."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.functions import normalize as norm

# Priorities that break ties.
SOURCES = ("vault", "user", "regex", "entropy", "rule", "llm", "gliner")
ACTIONS = ("mask", "generalize", "keep")
TRUSTED_RULES = ("link:", "entailed")
BASE_CONFIDENCE = {"vault": 1.0, "user": 1.0, "regex": 0.9, "entropy": 0.7, "rule": 0.6, "llm": 0.6, "gliner": 0.6}


def priority(value: Column, order: tuple[str, ...]) -> Column:
    """Place in a fixed order; 9 for anything else."""
    found = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(found > 0, found - 1).otherwise(F.lit(9)).cast("int")


def matches(text: Column, pattern: str) -> Column:
    """A pattern's matches as an array of (start, end, text), inside the JVM: matches are marked, the text is split at
    the marks, and lengths add up to offsets.  Marks that the text holds itself count as other characters while
    it is searched.  The pattern has no capturing group."""
    odd = F.rlike(text, F.lit("[\u0001\u0002]"))
    own = F.when(odd, F.translate(text, "\u0001\u0002", "\ufffd\ufffd")).otherwise(text)
    marked = F.split(F.regexp_replace(own, f"({pattern})", "\u0001$1\u0002"), "\u0001")
    pieces = F.transform(marked, lambda p, i: F.struct(i.alias("i"), F.replace(p, F.lit("\u0002"), F.lit("")).alias("all"), F.when(i > 0, F.substring_index(p, "\u0002", 1)).alias("hit")))
    walked = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["all"])).alias("at"),
            F.when(p["hit"].isNotNull(), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(p["hit"])).alias("end"), p["hit"].alias("text"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    raw = F.transform(walked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))
    return F.when(odd, raw).otherwise(walked)


def literal_spans(df: DataFrame, text: str, pattern: str, *keys: str) -> DataFrame:
    """(keys, start, end, text) of a pattern's matches, a row each; see `matches`."""
    found = df.where(F.rlike(F.col(text), F.lit(pattern))).select(*keys, F.explode(matches(F.col(text), pattern)).alias("s"))
    return found.select(*keys, "s.start", "s.end", "s.text")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolved(spans: Column) -> Column:
    """Of an array of span structs, the ones chosen greedily: longest, then source, then action, then
    start; empty and overlapping ones go; in order of start."""
    ranked = F.transform(
        F.filter(spans, lambda s: s["end"] > s["start"]),
        lambda s: F.struct((s["start"] - s["end"]).alias("_length"), priority(s["source"], SOURCES).alias("_source"), priority(s["action"], ACTIONS).alias("_action"), s["start"].alias("start"), s["end"].alias("end"), s.alias("span")),
    )
    choose = lambda r: F.aggregate(F.array_sort(r), F.slice(r, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    chosen = F.transform(F.array(ranked), choose)[0]  # through an array of one, so that the spans are worked out once
    by_start = F.array_sort(F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["span"].alias("span"))))
    return F.transform(by_start, lambda x: x["span"])


def resolve(df: DataFrame, key: str = "slot_id") -> DataFrame:
    """The chosen spans of each slot; `df` has one row for each span."""
    columns = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("spans"))
    return grouped.select(key, F.explode(resolved(F.col("spans"))).alias("s")).select(key, *[f"s.{c}" for c in columns])


def with_policy(df: DataFrame, level: str | Column) -> DataFrame:
    """Protection level, for spans of a model or a rule only: minimal keeps quasi-identifiers, strict masks
    what would be generalized."""
    lv = F.lit(level) if isinstance(level, str) else level
    own = F.col("source").isin("llm", "rule")
    action = F.when(own & (lv == "minimal") & (F.col("type") == "QUASI_IDENTIFIER"), "keep").when(own & (lv == "strict") & (F.col("action") == "generalize"), "mask").otherwise(F.col("action"))
    return df.withColumn("action", action)


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Ordered distinct: the first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def propagate(slots: DataFrame, spans: DataFrame, request: str = "req_id") -> DataFrame:
    """(request, slot_id, start, end, type, action, source, rule, text): every place, in all slots of a request, of each
    value that one of its spans has, as written or in a variant (`normalize.Searched`); offsets are those of the raw
    text.  Spans that keep their value count for nothing.  The first other span's type and action hold.  Copies
    of `link:` and entailed spans keep their rule, others are `propagated`.

    slots: (request, slot_id, text); spans: (request, slot_id, start, type, action, source, rule, text).  A slot's
    text travels once, with the values of its request."""
    kinds = dict(slots.dtypes)
    rule = F.when(F.col("rule").startswith("link:") | F.startswith("rule", F.lit("entailed")), F.col("rule")).otherwise("propagated")
    active = spans.where((F.col("action") != "keep") & (F.length(F.trim("text")) >= 2))
    values = active.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("slot_id", "start", "type", "action", "source", rule.alias("rule"), "text"))).alias("_values"))
    fields = ("type", "action", "source", "rule", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, (text, found) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_values").to_pylist(), strict=True)):
                first: dict[str, dict] = {}
                for v in found:
                    first.setdefault(norm.normalize(v["text"]), v)
                searched = norm.Searched(text)
                for v in first.values():
                    for start, end in searched.places(v["text"]):
                        at.append(i)
                        rows.append((start, end, *(v[f] for f in fields)))
            own = batch.select([request, "slot_id"]).take(pa.array(at, pa.int64()))
            made = [pa.array([r[k] for r in rows], pa.int32() if k < 2 else pa.string()) for k in range(2 + len(fields))]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], [request, "slot_id", "start", "end", *fields])

    met = slots.where("text is not null").select(request, "slot_id", "text").join(values, request)
    return met.mapInArrow(run, f"{request} {kinds[request]}, slot_id {kinds['slot_id']}, start int, end int, type string, action string, source string, rule string, text string")


def agreement(a: DataFrame, b: DataFrame, key: str = "slot_id") -> DataFrame:
    """Overlap join of two span tables: pairs that share at least half of the shorter one."""
    x, y = a.alias("x"), b.alias("y")
    shared = F.least("x.end", "y.end") - F.greatest("x.start", "y.start")
    shorter = F.least(F.col("x.end") - F.col("x.start"), F.col("y.end") - F.col("y.start"))
    met = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}")).where((F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end")))
    return met.withColumn("shared", shared).withColumn("agrees", F.col("shared") * 2 >= shorter)


def confidence(df: DataFrame, strict_rules: list[str], key: str = "slot_id") -> DataFrame:
    """Each span's overlapping sources and its confidence: 0.99 for strict rules, else its source's base,
    0.25 more, up to 0.95, if other sources overlap it."""
    held = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(F.struct(*[c for c in df.columns if c != key])).alias("_all"))
    each = held.select(key, "_all", F.explode("_all").alias("_own"))
    met = each.select(key, "_own", F.filter("_all", lambda y: overlaps(F.col("_own"), y)).alias("_met")).where(F.size("_met") > 0)
    sources = met.select(*[F.col(c if c == key else f"_own.{c}").alias(c) for c in df.columns], F.array_sort(F.array_distinct(F.array_compact(F.transform("_met", lambda y: y["source"])))).alias("sources"))
    base = F.coalesce(F.create_map(*[F.lit(v) for kv in BASE_CONFIDENCE.items() for v in kv])[F.col("source")], F.lit(0.5))
    value = F.when(F.col("rule").isin(*strict_rules), 0.99).when(F.size("sources") > 1, F.round(F.least(base + 0.25, F.lit(0.95)), 2)).otherwise(base)
    return sources.withColumn("confidence", value)


def covered(df: DataFrame, key: str = "slot_id") -> DataFrame:
    """Merged intervals of each slot: gaps and islands over the running maximum of ends."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def sentences(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, sentence_no, start, sentence): pieces between runs of sentence ends and line breaks."""
    pieces = literal_spans(df, text, r"[^.!?。\n]+", *keys)
    w = Window.partitionBy(*keys).orderBy("start")
    return pieces.where(F.trim("text") != "").select(*keys, F.row_number().over(w).alias("sentence_no"), "start", F.col("text").alias("sentence"))


def chunked(df: DataFrame, text: str, *keys: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(keys, chunk_no, chunk): a text of up to `size` characters whole; a longer one in chunks that lines, and the
    breaks between them, are packed into.  A line that is longer itself is cut into pieces that share `overlap`
    characters, the last of which others may follow in its chunk.  Null texts have no chunks."""
    step = size - overlap
    n = F.length(text)
    start = F.expr("named_struct('held', '', 'out', cast(array() as array<string>))")

    def pack(acc: Column, piece: Column) -> Column:
        full = (F.length(acc["held"]) + F.length(piece) > size) & (acc["held"] != "")
        out = F.when(full, F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])
        cuts = F.when(F.length(piece) > size, F.ceil((F.length(piece) - size) / F.lit(step))).otherwise(0).cast("int")
        ready = F.when(cuts > 0, F.concat(out, F.transform(F.sequence(F.lit(0), F.greatest(cuts, F.lit(1)) - 1), lambda i: F.substring(piece, i * step + 1, F.lit(size))))).otherwise(out)
        rest = F.substring(piece, cuts * step + 1, F.length(piece))
        return F.struct(F.concat(F.when(full, "").otherwise(acc["held"]), rest).alias("held"), ready.alias("out"))

    packed = F.aggregate(F.regexp_extract_all(text, F.lit(r"[^\n]+|\n+"), F.lit(0)), start, pack, lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))
    cut = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.when(n <= size, F.array(F.col(text))).otherwise(packed)).alias("at", "chunk"))
    return cut.select(*keys, (F.col("at") + 1).alias("chunk_no"), "chunk")


def windows_of(text: str, words: int, chars: int, back: float) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows of a text; see `word_windows`."""
    places = [m.span() for m in re.finditer(r"[^\s]+", text, re.ASCII)]
    i, n = 0, len(places)
    while i < n:
        j = i + 1
        while j < n and j - i < words and places[j][1] - places[i][0] <= chars:
            j += 1
        yield places[i][0], places[j - 1][1]
        i = n if j == n else max(i + 1, j - max(1, int((j - i) * back)))


def word_windows(df: DataFrame, text: str, *keys: str, words: int = 120, chars: int = 600, back: float = 0.25) -> DataFrame:
    """(keys, window_no, start, window): runs of up to `words` words within `chars` characters, one word at least, each
    beginning `back` of the last one's words before its end, as they stand in the text; `start` is a window's offset."""
    kinds, n = dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(n).to_pylist()):
                own = [(k, start, t[start:end]) for k, (start, end) in enumerate(windows_of(t or "", words, chars, back))]
                at += [i] * len(own)
                rows += own
            kept = batch.select(list(range(n))).take(pa.array(at, pa.int64()))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*keys, "window_no", "start", "window"])

    return df.select(*keys, text).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "window_no int, start int, window string"]))
