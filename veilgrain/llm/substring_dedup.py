"""Substring dedup: compressed FM-indexes of shards, matching statistics of streamed documents.

A window is 20 consecutive words.  Words that a window covers whose words also start earlier (in a
document of smaller id, or earlier in the same one) are removed.

1. Copies: of documents with the same words only the first is looked at; a later one loses all its
   words (if it has a window).
2. Anchors: each window is known by the least hash of its runs of four words, so equal windows have
   equal anchors; consecutive windows with the anchor at one place form a run.  Runs whose anchor occurs once in
   the corpus can't repeat and are done with.
3. Shards: the other runs' words go to the shard of their anchor, so equal windows meet in a shard.
   Of an anchor with more than HOT runs only the first of equal runs goes on (a map-side combined
   aggregate); all others are repeats as a whole.  It is split into single windows, of which again only
   the first of equal ones goes on, to the shard of its own hash: no window fills a shard by itself.
4. Each shard's distinct runs are indexed (`fm_index`) and streamed through the index by backward
   search; windows that occur earlier are reported as intervals of words.

Words are compared by 32 bits of their hashes here, so by 640 bits for a window: two different
windows are taken for equal only if each pair of differing words collides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.fm_index import Index
from veilgrain.llm.scratch import keep
from veilgrain.llm.text import Words, chunks, rolling, small_batches, text_bytes

WINDOW, GRAM = 20, 4
MOST_RUN = 32  # windows; longer runs are cut
HOT = 20_000
SHARD_WORDS = 1_000_000
_U = np.uint64


def runs_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first word, windows) of each run, in order."""
    hashes = words.hashes
    if len(hashes) < WINDOW:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(hashes) - GRAM + 1
    at = np.arange(m)
    low, where = rolling(hashes, at, at + GRAM), at
    width, step = 1, 1
    while width < WINDOW - GRAM + 1:  # the least over 17 grams, by doubling
        step = min(width, WINDOW - GRAM + 1 - width)
        later = low[step:] < low[:-step]  # of equal ones the first counts
        low, where = np.where(later, low[step:], low[:-step]), np.where(later, where[step:], where[:-step])
        width += step
    text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(text_of[: len(hashes) - WINDOW + 1] == text_of[WINDOW - 1 :])
    anchor = low[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (where[at[1:]] != where[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(new | (since % MOST_RUN == 0))
    return anchor[begin], at[begin], np.diff(np.append(begin, len(at)))


SKETCH = "doc_id long, text_hash long, n_words long, sha256 string, key binary, anchors array<long>, places array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = text_bytes(batch.column("text"))
        for start, some in chunks(texts):
            words = Words(some)
            anchors, at, size = runs_of(words)
            first = np.searchsorted(at, words.first)
            own = batch.slice(start, len(some))
            plain = [b" ".join(t.split()) for t in some]
            lists = pa.array(first, pa.int32())
            place = (at - np.repeat(words.first[:-1], np.diff(first))) * MOST_RUN + size - 1
            yield pa.RecordBatch.from_arrays(
                [
                    own.column("doc_id"),
                    own.column("text_hash"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in plain], pa.string()),
                    pa.array([xxhash.xxh128_digest(p) for p in plain], pa.binary()),
                    pa.ListArray.from_arrays(lists, pa.array(anchors.view(np.int64), pa.int64())),
                    pa.ListArray.from_arrays(lists, pa.array(place, pa.int64())),
                ],
                [x.split()[0] for x in SKETCH.split(", ")],
            )


SNIPPETS = "doc_id long, text_hash long, start int, shard_key long, hot boolean, words binary"


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each suspect run."""
    for batch in small_batches(batches):
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for doc_id, text_hash, text, spots in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), text_bytes(batch.column("text")), batch.column("spots").to_pylist(), strict=True):
            short = (Words([text or b""]).hashes >> _U(32)).astype(np.uint32)
            for spot in spots:
                start, size = spot["place"] // MOST_RUN, spot["place"] % MOST_RUN + 1
                for column, value in zip(rows, (doc_id, text_hash, start, spot["anchor"], spot["hot"], short[start : start + size + WINDOW - 1].tobytes()), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in SNIPPETS.split(", ")])


WINDOWS = "doc_id long, text_hash long, start int, shard_key long, words binary"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of runs, each with its own hash as the key of its shard."""
    for batch in small_batches(batches, 1 << 20):
        words = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("words").to_pylist()]
        count = np.array([len(x) - WINDOW + 1 for x in words], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), count)
        since = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        whole = np.concatenate([np.zeros(0, np.uint32), *words])
        at = since + np.repeat(np.cumsum(count + WINDOW - 1) - count - WINDOW + 1, count)
        keys = rolling(whole.astype(_U), at, at + WINDOW).view(np.int64)
        pieces = [whole[a : a + WINDOW].tobytes() for a in at.tolist()]
        start = batch.column("start").to_numpy()[owner] + since
        columns = [batch.column("doc_id").take(pa.array(owner)), batch.column("text_hash").take(pa.array(owner)), pa.array(start, pa.int32()), pa.array(keys, pa.int64()), pa.array(pieces, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in WINDOWS.split(", ")])


INTERVALS = "doc_id long, text_hash long, start int, stop int"


def _searched(table: pa.Table) -> pa.Table:
    """Intervals of repeated words in one shard's snippets."""
    doc, text_hash, start = (table.column(c).to_numpy() for c in ("doc_id", "text_hash", "start"))
    content = table.column("words").to_pylist()
    order = np.lexsort((start, text_hash, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (text_hash[order][1:] != text_hash[order][:-1])
    document = np.empty(len(order), dtype=np.int64)
    document[order] = np.cumsum(new) - 1
    place = document << 32 | start
    leader: dict[bytes, int] = {}  # the earliest snippet with these words
    for i in order:
        leader.setdefault(content[i], int(i))
    distinct = np.array(list(leader.values()))
    size = np.array([len(content[i]) // 4 for i in distinct])
    whole = np.frombuffer(b"".join(content[i] + b"\0\0\0\0" for i in distinct), dtype=np.uint32)
    ends = np.cumsum(size + 1) - 1
    text = np.unique(whole, return_inverse=True)[1].astype(np.int64) + 1
    text[ends] = 0
    offset = np.arange(len(whole)) - np.repeat(ends - size, size + 1)
    own = np.repeat(place[distinct], size + 1) + offset
    index = Index(text, own, WINDOW)
    _, at, _, least = index.statistics(text, ends, size)
    repeated = np.zeros(len(whole), dtype=bool)
    repeated[at[least < own[at]]] = True
    out: list[tuple[int, int, int]] = []
    row_of = {content[i]: k for k, i in enumerate(distinct)}
    for i, words in enumerate(content):
        k = row_of[words]
        if place[i] != place[distinct[k]]:
            out.append((i, int(start[i]), int(start[i]) + int(size[k])))
            continue
        begin = ends[k] - size[k]
        hits = np.flatnonzero(repeated[begin : ends[k]])
        if len(hits):
            cut = np.flatnonzero(np.diff(hits) > 1)
            for a, b in zip(hits[np.append(0, cut + 1)], hits[np.append(cut, len(hits) - 1)], strict=True):
                out.append((i, int(start[i] + a), int(start[i] + b) + WINDOW))
    rows = [o[0] for o in out]
    return pa.table({"doc_id": pa.array(doc[rows], pa.int64()), "text_hash": pa.array(text_hash[rows], pa.int64()), "start": pa.array([o[1] for o in out], pa.int32()), "stop": pa.array([o[2] for o in out], pa.int32())})


RESULT = "doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        n, removed, kept = [], [], []
        for text, starts, stops in zip(text_bytes(batch.column("text")), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True):
            words = (text or b"").split()
            drop = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(drop, np.array(starts or [], dtype=np.int64), 1)
            np.add.at(drop, np.array(stops or [], dtype=np.int64), -1)
            gone = np.cumsum(drop)[:-1] > 0
            n.append(len(words))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
        digest = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            [x.split()[0] for x in RESULT.split(", ")],
        )


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of rows of one key with equal words, and the intervals of all others."""
    place = F.struct("doc_id", "text_hash", "start")
    firsts = keep(rows.groupBy("shard_key", "words").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    again = rows.join(firsts.where("n > 1"), ["shard_key", "words"]).where(place != F.col("first"))
    stop = F.col("start") + (F.octet_length("words") / 4).cast("int")
    return firsts.select("first.*", "shard_key", "words"), again.select("doc_id", "text_hash", "start", stop.alias("stop"))


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of `docs` (doc_id, text; other columns
    are ignored); `kept` is the remaining words joined by blanks, and is left out without `with_text`.

    Null and empty texts have no words and keep the digest of an empty string.  Of rows that share a
    doc_id the one with the smaller text hash comes first; rows alike in both are the same document and
    get the same result.  A null id comes before all others.  An empty table gives an empty result."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    null_id = -(1 << 63)
    own = own.withColumn("doc_id", F.coalesce("doc_id", F.lit(null_id)))
    sketch = keep(own.mapInArrow(_sketched, SKETCH))
    firsts = sketch.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    joined = sketch.join(firsts, "key").withColumn("is_copy", F.struct("doc_id", "text_hash") != F.col("first")).drop("first", "key")
    plain = keep(joined.select("doc_id", "text_hash", "n_words", "sha256", "is_copy"))
    ref = ("doc_id", "text_hash")
    spots = joined.where("not is_copy").select(*ref, F.explode(F.arrays_zip("anchors", "places")).alias("s"))
    spots = keep(spots.select(*ref, F.col("s.anchors").alias("anchor"), F.col("s.places").alias("place")))
    often = spots.groupBy("anchor").agg(F.count("*").alias("met")).where("met > 1")
    often = keep(often.select("anchor", (F.col("met") > HOT).alias("hot")))  # a table, so that the join may split a hot anchor's rows
    suspects = spots.join(often, "anchor").groupBy(*ref).agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("spots"))
    texts = own.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h")
    held = keep(texts.join(suspects, (F.col("d") == F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).select(*ref, "text", "spots"))
    snippets = keep(held.mapInArrow(_snippets, SNIPPETS))
    runs, again = _parted(snippets.where("hot").drop("hot"))
    windows, more = _parted(keep(runs.select(*ref, "start", "words").mapInArrow(_split, WINDOWS)))
    snippets = snippets.where("not hot").drop("hot").unionByName(windows)
    words = snippets.agg(F.sum(F.octet_length("words") / 4)).first()[0] or 0
    shards = max(1, -(-int(words) // SHARD_WORDS))
    found = snippets.withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(shards))).groupBy("shard").applyInArrow(_searched, INTERVALS).unionByName(again).unionByName(more)
    cuts = found.groupBy(*ref).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    # Documents with intervals are cut; of all others the outcome is known.
    cut = held.drop("spots").join(cuts, list(ref)).dropDuplicates(list(ref)).select(*ref, "text", "starts", "stops")
    done = cut.mapInArrow(_cut, RESULT).withColumnRenamed("n_words", "_n").withColumnRenamed("kept", "_kept")
    done = done if with_text else done.drop("_kept")
    all_rows = plain.join(done, list(ref), "left")
    gone = F.col("is_copy") & (F.col("n_words") >= WINDOW)
    out = all_rows.select(
        *ref,
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *([F.when(gone, F.lit("")).otherwise(F.col("_kept")).alias("kept")] if with_text else []),
    )
    if with_text:
        whole = texts.withColumn("_plain", F.array_join(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), " ")).dropDuplicates(["d", "h"]).select("d", "h", "_plain")
        out = out.join(whole, (F.col("d") == F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).withColumn("kept", F.coalesce("kept", "_plain", F.lit("")))
    shown = ["n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    return out.select(F.when(F.col("doc_id") != null_id, F.col("doc_id")).alias("doc_id"), *shown)
