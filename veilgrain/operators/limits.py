"""Limits on events: sliding windows, daily budgets, addresses, re-ranking."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """`events` with `recent`: those of the same key in the last `seconds`, one exactly that old excluded."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("recent", F.count("*").over(w))


def admitted(events: DataFrame, key: str, at: str, limit: int, seconds: int, tie: str) -> DataFrame:
    """(key, tie, at, admitted, retry_after): exact replay of a sliding limiter, in which only admitted hits
    count.  It is recursive, so a key's hits pass in order of time; only the admitted ones in the window, `limit` at
    most, are held."""
    kinds, window = dict(events.dtypes), seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = None, deque()
        for batch in batches:
            ok, wait = [], []
            for name, now in zip(batch.column(key).to_pylist(), batch.column("_at").to_pylist(), strict=True):
                if known != (name,):
                    known = (name,)
                    held.clear()
                while held and now - held[0] >= window:
                    held.popleft()
                ok.append(len(held) < limit)
                wait.append(None if ok[-1] else (window - (now - held[0])) / 1e6 if held else float("inf"))
                if ok[-1]:
                    held.append(now)
            columns = [batch.column(c) for c in (key, tie, "_at")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ok, pa.bool_()), pa.array(wait, pa.float64())], [key, tie, "_at", "admitted", "retry_after"])

    hits = events.where(F.col(at).isNotNull()).select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"))
    placed = hits.repartition(key).sortWithinPartitions(key, "_at", tie)
    out = placed.mapInArrow(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, _at long, admitted boolean, retry_after double")
    return out.select(key, tie, F.timestamp_micros("_at").alias(at), "admitted", "retry_after")


def spent(events: DataFrame, at: str, cost: str, budget: float, tie: str, *keys: str) -> DataFrame:
    """`events` with what its UTC day has spent so far, and whether that is within the budget; 0 disables it."""
    w = Window.partitionBy(*keys, F.to_date(at)).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(cost).over(w)
    return events.withColumn("day", F.to_date(at)).withColumn("spent", total).withColumn("within", F.lit(budget == 0) | (F.col("spent") <= budget))


def client_ip(forwarded: Column, peer: Column, hops: int) -> Column:
    """The n-th forwarded entry from the right, else the peer."""
    parts = F.filter(F.transform(F.split(forwarded, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((hops > 0) & (F.size(parts) >= hops), F.try_element_at(parts, F.lit(-max(hops, 1)))).otherwise(peer)


def reranked(results: DataFrame, query: str, context: str, text: str, *keys: str, index: str = "idx") -> DataFrame:
    """Results by the number of query and context words they share, then by their order."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w{2,}"), F.lit(0)))
    shared = F.size(F.array_intersect(words(F.concat_ws(" ", F.col(query), F.coalesce(F.col(context), F.lit("")))), words(F.col(text))))
    w = Window.partitionBy(*keys).orderBy(F.col("shared").desc(), index)
    return results.withColumn("shared", shared).withColumn("place", F.row_number().over(w))


def repaired_order(proposed: Column, n: Column) -> Column:
    """A model's order of 0..n-1: valid numbers once each, then the missing ones."""
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    valid = F.array_distinct(F.filter(proposed, lambda x: (x >= 0) & (x < n)))
    return F.concat(valid, F.array_except(every, valid))


def clean_query(text: Column, most: int = 400) -> Column:
    """Single blanks, no quotes around, placeholders redacted, cut to length."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[\"'`]+|[\"'`]+$", "")
    return F.substring(F.regexp_replace(plain, r"<[A-Z][A-Z_]*_\d+>", "[REDACTED]"), 1, most)


def should_fallback(status: Column, body: Column) -> Column:
    """Another model is worth a try: server errors, not found, or a complaint about the model."""
    model = F.rlike(body, F.lit("(?i)model")) & F.rlike(body, F.lit("(?i)not found|unavailable|not available|does not exist|unknown|unsupported|not supported|deprecated"))
    return (status >= 500) | (status == 404) | (status.isin(400, 403, 422) & model)
