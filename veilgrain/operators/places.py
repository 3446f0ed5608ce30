"""Places of texts over tables: containers of containers, mentions, and what they generalize to.

A gazetteer is a table (name, container, kind).  Up to GAZETTEER_BYTES, measured, it goes to the tasks as a matcher;
a larger one is joined by what the texts may name, so each row gets the part that it asks for.  Both give the same
results."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.functions import fitting
from veilgrain.functions.regions import Gazetteer, cuts
from veilgrain.operators import spans

GAZETTEER_BYTES = 32 << 20


def ancestors(gazetteer: DataFrame) -> DataFrame:
    """(name, ancestor, depth): all containers of a place, by joining paths to paths, so in as many rounds as the
    depth has binary digits.  A place that would contain itself doesn't."""
    known = gazetteer.where("name is not null and container is not null and name <> container").groupBy("name").agg(F.min("container").alias("ancestor"))
    paths = known.withColumn("depth", F.lit(1))
    while True:
        a, b = paths.alias("a"), paths.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.name")).select("a.name", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        every = paths.union(longer.where("name <> ancestor")).groupBy("name", "ancestor").agg(F.min("depth").alias("depth"))
        if every.count() == paths.count():
            return every
        paths = every


def tops(gazetteer: DataFrame) -> DataFrame:
    """(name, top): the outermost container."""
    return ancestors(gazetteer).groupBy("name").agg(F.max_by("ancestor", F.struct("depth", "ancestor")).alias("top"))


def measured(gazetteer: DataFrame) -> int:
    size = F.octet_length("name") + F.coalesce(F.octet_length("container"), F.lit(0)) + 48
    return int(gazetteer.agg(F.sum(size)).first()[0] or 0)


def collected(gazetteer: DataFrame) -> Gazetteer | None:
    """The gazetteer as a matcher, if its measured size is within the bound; a larger one is for `with_parts`."""
    if measured(gazetteer) > GAZETTEER_BYTES:
        return None
    rows = gazetteer.select("name", "container", "kind").where("name is not null").orderBy("name", "container", "kind").toArrow()
    return Gazetteer(zip(*[rows.column(c).to_pylist() for c in ("name", "container", "kind")], strict=True))


def _lengths(gazetteer: DataFrame, *columns: str) -> list[int]:
    """Lengths of names, as many as the longest has characters at most."""
    sizes = gazetteer.select(F.explode(F.array(*[F.length(c) for c in columns])).alias("n")).where("n > 0").distinct()
    return sorted(r.n for r in sizes.collect())


def _entries(gazetteer: DataFrame) -> DataFrame:
    """(asked, row): for a name its own row and those of all that contains it, for a container a row that shows it.
    Of several rows of a name the first counts, as in a matcher."""
    first = gazetteer.where("name <> ''").groupBy("name").agg(F.min(F.struct("container", "kind")).alias("x")).select("name", "x.*")
    row = F.struct("name", "container", "kind")
    own = first.select(F.col("name").alias("asked"), row.alias("row"))
    above = ancestors(first).withColumnRenamed("name", "asked").join(own.withColumnRenamed("asked", "ancestor"), "ancestor").select("asked", "row")
    return own.union(above).union(first.where("container <> ''").groupBy(F.col("container").alias("asked")).agg(F.min(row).alias("row")))


def with_parts(rows: DataFrame, value: str, said: str, gazetteer: DataFrame) -> DataFrame:
    """The rows with `_part`, the rows of the gazetteer that decide on a value and a phrase, whatever the size of either
    side: what they ask for is joined with names and containers.  Neither column may be null."""
    lengths = _lengths(gazetteer, "name", "container")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(Gazetteer.asked(v, s, lengths)) for v, s in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.list_(pa.string()))], [value, said, "asked"])

    asked = rows.select(value, said).distinct().mapInArrow(run, f"{value} string, {said} string, asked array<string>")
    found = asked.select(value, said, F.explode("asked").alias("asked")).join(_entries(gazetteer), "asked").groupBy(value, said).agg(F.collect_set("row").alias("_part"))
    return rows.join(found, [value, said], "left")


def of_parts(column: pa.Array) -> Iterator[Gazetteer]:
    """A matcher for each row's part."""
    made: dict[tuple, Gazetteer] = {}
    for part in column.to_pylist():
        rows = tuple(sorted(((x["name"], x["container"], x["kind"]) for x in part or ()), key=str))
        if rows not in made:
            made[rows] = Gazetteer(rows)
        yield made[rows]


def mentions(df: DataFrame, text: str, gazetteer: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end, place, top): names of the gazetteer that have a container, where they stand as words in any
    alphabet; of those that overlap the longest, then the first."""
    names = gazetteer.where("name is not null and container is not null").groupBy("name").agg(F.min("container").alias("container"))
    small = measured(gazetteer) <= GAZETTEER_BYTES
    found = _by_matcher(df, text, names, *keys) if small else _by_join(df, text, names, *keys)
    found = found.withColumns({"source": F.lit("rule"), "action": F.lit("generalize"), "_key": F.struct(*keys)}).drop(*keys)
    chosen = spans.resolve(found, "_key").select("_key.*", "start", "end", F.col("text").alias("place"))
    return chosen.join(tops(gazetteer).withColumnRenamed("name", "place"), "place").select(*keys, "start", "end", "place", "top")


def _by_matcher(df: DataFrame, text: str, names: DataFrame, *keys: str) -> DataFrame:
    known = [r.name for r in names.select("name").orderBy("name").collect()]  # within GAZETTEER_BYTES
    kinds, n = dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Gazetteer._matcher(known)
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(n).to_pylist()):
                for last, name in matcher.iter(t) if t and known else ():
                    start = last + 1 - len(name)
                    if not (start and t[start - 1].isalnum()) and not (last + 1 < len(t) and t[last + 1].isalnum()):
                        at.append(i)
                        rows.append((start, last + 1, name))
            own = batch.select(list(range(n))).take(pa.array(at, pa.int64()))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], [*keys, "start", "end", "text"])

    return df.select(*keys, text).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "start int, end int, text string"]))


def _by_join(df: DataFrame, text: str, names: DataFrame, *keys: str) -> DataFrame:
    """Whatever is as long as a name and stands between other characters than letters and digits, joined with the names,
    whatever the size of either side."""
    kinds, n, lengths = dict(df.dtypes), len(keys), _lengths(names, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(n).to_pylist()):
                rows = [(a, b, t[a:b]) for a, b in cuts(t or "", lengths, str.isalnum)]
                own = batch.select(list(range(n))).take(pa.array([i] * len(rows), pa.int64()))
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*own.columns, *made], [*keys, "start", "end", "text"])

    sequences = df.select(*keys, text).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "start int, end int, text string"]))
    return sequences.join(names.select(F.col("name").alias("text")), "text").select(*keys, "start", "end", "text")


def generalized(df: DataFrame, value: str, lang: str, gazetteer: DataFrame, *keys: str, proposed: str | None = None) -> DataFrame:
    """(keys, phrase, consistent): what a value that is nothing but a place becomes, and whether each region that the
    proposed phrase names contains the value's places."""
    known = collected(gazetteer)
    kinds, n = dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, langs, said = (batch.column(n + k).to_pylist() for k in range(3))
            matchers = list(of_parts(batch.column(n + 3))) if known is None else [known] * len(values)
            phrases = [None if v is None else m.phrase(v, g or "en") for v, g, m in zip(values, langs, matchers, strict=True)]
            fits = [None if v is None or s is None else m.consistent(v, s) for v, s, m in zip(values, said, matchers, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(phrases, pa.string()), pa.array(fits, pa.bool_())], [*keys, "phrase", "consistent"])

    rows = df.select(*keys, F.col(value).alias("_value"), F.col(lang).alias("_lang"), (F.col(proposed) if proposed else F.lit(None).cast("string")).alias("_said"))
    if known is None:
        rows = with_parts(rows.withColumns({"_v": F.coalesce("_value", F.lit("")), "_s": F.coalesce("_said", F.lit(""))}), "_v", "_s", gazetteer).select(*keys, "_value", "_lang", "_said", "_part")
    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "phrase string, consistent boolean"]))


FIXED = "start int, end int, replacement string, outcome string"


def fixed_generalizations(spans_: DataFrame, today: date, gazetteer: DataFrame | None, *keys: str) -> DataFrame:
    """(keys, start, end, replacement, outcome) of spans (keys, slot_text, start, end, replacement, type) that are to be
    generalized: see `fitting.fixed`.  `today` is stated, so reruns agree."""
    known = None if gazetteer is None else collected(gazetteer)
    by_part = gazetteer is not None and known is None
    kinds, n = dict(spans_.dtypes), len(keys)

    def slots(batch: pa.RecordBatch) -> list[fitting.Slot]:
        columns = [batch.column(n + k).to_pylist() for k in range(5)]
        return [fitting.Slot(text or "", start, end, said or "", kind or "") for text, start, end, said, kind in zip(*columns, strict=True)]

    def with_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = slots(batch)
            made = [pa.array(x, pa.string()) for x in ([s.value for s in own], [s.replacement.strip() for s in own])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_v", "_s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, matcher in zip(slots(batch), of_parts(batch.column(n + 5)) if by_part else repeat(known)):
                slot, outcome = fitting.fixed(own, today, matcher)
                out.append((slot.start, slot.end, slot.replacement, outcome))
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *made], [*keys, "start", "end", "replacement", "outcome"])

    rows = spans_.where("start is not null and end is not null").select(*keys, "slot_text", F.col("start").cast("int"), F.col("end").cast("int"), "replacement", "type")
    if by_part:
        shown = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        rows = with_parts(rows.mapInArrow(with_pairs, f"{shown}, _v string, _s string"), "_v", "_s", gazetteer).select(*rows.columns, "_part")
    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), FIXED]))
