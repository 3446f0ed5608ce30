"""Sharding by sampled splitters, near-equal in bytes.

Records are ordered by (key, doc_id), the key being 60 bits of the MD5 of the text, so equal texts
lie together.  A size-weighted sample of keys gives quantile boundaries, which cut the records into
ranges of a few times the wanted number; a key so heavy that it is drawn several times becomes a
range of its own, and such overfull ranges are subdivided by sampled doc_ids.  Exact sizes of the
ranges then give every record its offset in the whole order, and from it its shard and slot; windows
span single ranges only.  The result depends on the order and on exact sizes alone, not on the sample.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.llm.scratch import keep

SHARDS = 16
RANGE_BYTES = 16 << 20  # wanted size of a range, of the records' texts
LEAST_RANGES, MOST_RANGES = 64, 65536  # at 100 TB a range has 1.5 GB of texts, so some hundred thousand short records
DRAWS_PER_RANGE = 16  # so at most MOST_RANGES * DRAWS_PER_RANGE samples reach the driver, or about so
WHOLE_SHARE = 0.02  # equal texts of up to this share of a shard are never parted
FIRST_ID = -(1 << 63)


def _key() -> Column:
    """60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, key, other): size is the text's UTF-8 bytes plus 1; `other` is a hash of the
    columns `carry`."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        _key().alias("key"),
        (F.xxhash64(*carry) if carry else F.lit(0).cast("long")).alias("other"),
    )


def splitters(records: DataFrame, ranges: int, total: int) -> list[tuple[int, int]]:
    """Sorted boundaries (key, doc_id), from records drawn with a probability that grows with size.

    A record is drawn once for each of its expected draws, rounded by a hash.  Boundaries are quantiles
    of the draws; a key that is a boundary more than once is heavy: it begins a range, is cut by the
    doc_ids drawn with it, and the next key begins a range."""
    rate = ranges * DRAWS_PER_RANGE / max(total, 1)
    chance = F.pmod(F.xxhash64("key", "doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.select("key", F.coalesce("doc_id", F.lit(FIRST_ID)).alias("doc_id"), F.floor(F.col("size") * rate + chance).cast("long").alias("draws")).where("draws > 0")
    rows = drawn.toArrow()
    keys, ids, draws = (rows.column(c).to_numpy() for c in ("key", "doc_id", "draws"))
    order = np.lexsort((ids, keys))
    keys, ids, reach = keys[order], ids[order], np.cumsum(draws[order])
    if not len(keys):
        return []
    picks = np.minimum(np.searchsorted(reach, np.arange(1, ranges) * reach[-1] / ranges), len(keys) - 1)
    by_key: dict[int, list[int]] = defaultdict(list)
    for p in picks:
        by_key[int(keys[p])].append(int(ids[p]))
    out = set()
    for k, own in by_key.items():
        out.add((k, FIRST_ID))
        if len(own) > 1:
            out.add((k + 1, FIRST_ID))
            out.update((k, i) for i in own)
    return sorted(out)


def _ranged(bounds: list[tuple[int, int]], schema: list[str]):
    keys = np.array([b[0] for b in bounds], dtype=np.int64)
    cuts: dict[int, list[int]] = defaultdict(list)
    for k, i in bounds:
        cuts[k].append(i)
    heavy = {k: np.array(own) for k, own in cuts.items() if len(own) > 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sorted(heavy), dtype=np.int64)
        for batch in batches:
            key = batch.column("key").to_numpy()
            part = np.searchsorted(keys, key, side="right")
            in_heavy = np.isin(key, names)
            for k in np.unique(key[in_heavy]).tolist():
                own = np.flatnonzero(key == k)
                ids = batch.column("doc_id").fill_null(FIRST_ID).to_numpy()[own]
                part[own] = np.searchsorted(keys, k, side="left") + np.searchsorted(heavy[k], ids, side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], [*schema, "part"])

    return run


def _small_heavy(records: DataFrame, bounds: list[tuple[int, int]], most: float) -> dict[int, int]:
    """For each range of a key that the sample cut, but whose exact size is at most `most`: the key's first range."""
    first: dict[int, int] = {}
    parts: dict[int, list[int]] = defaultdict(list)
    for at, (k, _) in enumerate(bounds):
        parts[k].append(at + 1)
    cut = {k: own for k, own in parts.items() if len(own) > 1}
    if cut:
        sizes = records.where(F.col("key").isin(list(cut))).groupBy("key").agg(F.sum("size").alias("size")).toArrow()  # at most half as many keys as ranges
        for k, size in zip(sizes.column("key").to_pylist(), sizes.column("size").to_pylist(), strict=True):
            if size <= most:
                first |= dict.fromkeys(cut[k], cut[k][0])
    return first


def sharded(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns `carry`) for each row of
    `docs` (doc_id, text); the law is bytes.

    Offsets in the order (key, doc_id) are cut into `shards` equal parts.  Equal texts share the shard of
    the first of them unless they exceed WHOLE_SHARE of a shard; then each goes by its own offset.  Slots
    count from 0 in each shard, in the same order.  A null text counts as an empty one, of no bytes and
    size 1.  Rows that repeat a doc_id are rows of their own; null ids come first; an empty table
    gives an empty result.  Only the places are worked out; columns of `carry` join them at the end."""
    records = keep(keyed(docs, carry))
    total = int(records.agg(F.sum("size")).first()[0] or 0)
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-total // RANGE_BYTES)))
    bounds = splitters(records, ranges, total)
    together = _small_heavy(records, bounds, WHOLE_SHARE * total / shards)
    schema = ", ".join(f"{n} {t}" for n, t in records.dtypes) + ", part long"
    parted = records.mapInArrow(_ranged(bounds, records.columns), schema)
    sizes = parted.groupBy("part").agg(F.sum("size").alias("part_size")).toArrow()  # one row for each range
    part_size = dict(zip(sizes.column("part").to_pylist(), sizes.column("part_size").to_pylist(), strict=True))
    reach, before = 0, {}
    for part in sorted({*part_size, *together, *together.values()}):
        before[part] = reach
        reach += part_size.get(part, 0)
    spark = docs.sparkSession
    cut = {at + 1 for at in range(len(bounds)) if bounds[at][1] != FIRST_ID or at + 1 < len(bounds) and bounds[at + 1][0] == bounds[at][0]}
    rows = [(part, before[part], before[together[part]] if part in together else None, part in cut) for part in part_size]
    offsets = spark.createDataFrame(rows, "part long, before long, first long, cut boolean")
    run = Window.partitionBy("part").orderBy("key", "doc_id", "size", "other")
    placed = parted.join(F.broadcast(offsets), "part").withColumn("offset", F.col("before") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    group = Window.partitionBy("part", "key")
    whole = ~F.col("cut") & (F.sum("size").over(group) <= F.lit(WHOLE_SHARE * total / shards))
    at = F.when(whole, F.min("offset").over(group)).otherwise(F.coalesce("first", "offset"))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(at * F.lit(shards) / F.lit(max(total, 1)))).cast("int"))
    placed = placed.drop("before", "first", "cut")
    placed = keep(placed.withColumn("_in_part", F.row_number().over(Window.partitionBy("part", "shard").orderBy("offset", "doc_id", "other")).cast("long") - 1))
    counts = placed.groupBy("shard", "part").count().toArrow()  # a row for each range, and one more for each border between shards
    base, filled = [], defaultdict(int)
    for s, part, n in sorted(zip(*(counts.column(c).to_pylist() for c in ("shard", "part", "count")), strict=True)):
        base.append((s, part, filled[s]))
        filled[s] += n
    starts = spark.createDataFrame(base, "shard int, part long, base long")
    out = placed.join(F.broadcast(starts), ["shard", "part"])
    out = out.withColumns({"law": F.lit("bytes"), "slot": F.col("base") + F.col("_in_part"), "grown_shard": F.lit(None).cast("int")})
    shown = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    if not carry:
        return out.select(*shown)
    own, ref = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)), ["_id", "_key", "_other"]
    texts = docs.select(own.alias("_id"), _key().alias("_key"), F.xxhash64(*carry).alias("_other"), *[c for c in carry if c != "doc_id"]).dropDuplicates(ref)
    places = out.select(*shown, own.alias("_id"), F.col("key").alias("_key"), F.col("other").alias("_other"))
    return places.join(texts, ref).select(*shown, *[c for c in carry if c != "doc_id"])
