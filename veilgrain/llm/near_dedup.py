"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded,
verified by weighted Jaccard similarity.

A document's features are its runs of five words (all its words, where it has fewer), words being
`[^\\x20\\x09-\\x0D]+`.  A feature weighs its count times the mean inverse document frequency of its
words, an idf being 1 + log((1 + N) / (1 + df)) / log(1 + N), so between 1 and 2: rare wording
counts more, yet a passage doesn't lose its weight by being copied often.  Document frequencies
are counted over all documents, in a table of IDF_SLOTS hashed slots, which bounds what is
gathered and sent out again.

Thirty-six sampled lanes make twelve bands of three: two documents at the threshold of 0.8 share a
band with probability 0.9998.  Documents that share a band are compared exactly (`linkage`), and
linked documents form classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm import linkage
from veilgrain.llm.scratch import keep
from veilgrain.llm.text import Words, chunks, mix, rolling, small_batches, text_bytes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
LANES = BANDS * ROWS
IDF_SLOTS = 1 << 16
_U = np.uint64
_SEED = 0x5EED
_LANE_FACTORS = mix(np.arange(1, LANES + 1, dtype=_U) * _U(0xD1B54A32D192ED03) + _U(_SEED)) | _U(1)
_POOL_BITS = 16


def _pool() -> dict[str, np.ndarray]:
    """Random variates of the sampling scheme; each feature and lane picks one entry by hash."""
    draw = np.random.default_rng(_SEED)
    size = 1 << _POOL_BITS
    r, c, beta = draw.gamma(2.0, 1.0, size), draw.gamma(2.0, 1.0, size), draw.random(size)
    return {"r": r.astype(np.float32), "one_by_r": (1 / r).astype(np.float32), "log_c": np.log(c).astype(np.float32), "beta": beta.astype(np.float32)}


_POOL = _pool()


def sampled(features: np.ndarray, log_weights: np.ndarray) -> np.ndarray:
    """One hash for each lane of a weighted set; two sets agree in a lane with the probability of
    their weighted Jaccard similarity."""
    best = np.full(LANES, np.inf, dtype=np.float32)
    out = np.zeros(LANES, dtype=_U)
    for at in range(0, len(features), 512):
        h, w = features[at : at + 512], log_weights[at : at + 512]
        pick = ((h[:, None] * _LANE_FACTORS) >> _U(64 - _POOL_BITS)).astype(np.intp)
        beta = _POOL["beta"][pick]
        t = np.floor(w[:, None] * _POOL["one_by_r"][pick] + beta)
        score = _POOL["log_c"][pick] - _POOL["r"][pick] * (t - beta + 1)
        low = score.argmin(axis=0)
        lanes = np.arange(LANES)
        value = score[low, lanes]
        wins = value < best
        best[wins] = value[wins]
        out[wins] = mix(h[low] ^ (t[low, lanes].astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15)))[wins]
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies by slot, summed over the partition."""
    held = np.zeros(IDF_SLOTS + 1, dtype=np.int64)
    for batch in small_batches(batches):
        texts = text_bytes(batch.column("text"))
        for _, some in chunks(texts):
            words = Words(some)
            document = np.repeat(np.arange(len(some), dtype=np.int64), np.diff(words.first))
            slots = np.unique(document * IDF_SLOTS + (words.hashes >> _U(48)).astype(np.int64)) % IDF_SLOTS
            held[:-1] += np.bincount(slots, minlength=IDF_SLOTS)
        held[-1] += len(texts)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["slot", "documents"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """An idf for each slot, from all documents; at most IDF_SLOTS + 1 sums reach the driver."""
    rows = docs.select("text").mapInArrow(_frequencies, "slot long, documents long").groupBy("slot").agg(F.sum("documents").alias("documents")).toArrow()
    count = np.zeros(IDF_SLOTS + 1)
    count[rows.column("slot").to_numpy()] = rows.column("documents").to_numpy()
    total = count[-1]
    return (1 + np.log((1 + total) / (1 + count[:-1])) / np.log(2 + total)).astype(np.float32)


def _counted(some: list[bytes], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features (sorted) of each text, their counts, and the weights of one occurrence."""
    words = Words(some)
    value = idf[(words.hashes >> _U(48)).astype(np.intp)]
    hashes, at = words.windows(SHINGLE)
    sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    mean = (sums[at + SHINGLE] - sums[at]) / SHINGLE if len(at) else sums[:0]
    first = np.searchsorted(at, words.first)
    for i in range(len(some)):
        lo, hi = words.first[i], words.first[i + 1]
        if hi - lo >= SHINGLE:
            own, weight = hashes[first[i] : first[i + 1]], mean[first[i] : first[i + 1]]
            own, where, count = np.unique(own, return_index=True, return_counts=True)
            yield own, count, weight[where]
        elif hi > lo:
            yield rolling(words.hashes[lo:hi], np.array([0]), np.array([hi - lo])), np.ones(1, dtype=np.int64), np.array([value[lo:hi].mean()])
        else:
            yield hashes[:0], np.zeros(0, dtype=np.int64), np.zeros(0)


def weighted_sets(texts: list[bytes], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features (sorted) and weights of each text."""
    for _, some in chunks(texts):
        for own, count, weight in _counted(some, idf):
            yield own, count * weight


def weighted_jaccard(idf: np.ndarray) -> linkage.Similarity:
    def similarity(left: list[bytes], right: list[bytes]) -> np.ndarray:
        out = []
        for (a, wa), (b, wb) in zip(weighted_sets(left, idf), weighted_sets(right, idf), strict=True):
            _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            both = np.minimum(wa[ia], wb[ib]).sum()
            whole = wa.sum() + wb.sum() - both
            out.append(both / whole if whole else 0.0)
        return np.array(out)

    return similarity


def tokens(idf: np.ndarray) -> linkage.Features:
    """Each text's features, one that occurs n times being n tokens: the weight of shared tokens is the
    sum of least weights."""

    def of_texts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, some in chunks(texts):
            for own, count, weight in _counted(some, idf):
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                repeated = np.repeat(own, count)
                later = nth > 0
                repeated[later] = mix(repeated[later] ^ mix(nth[later].astype(_U)))
                yield repeated, np.repeat(weight, count)

    return of_texts


SIGNED = "_id long, _hash long, key binary, bands array<long>"
_NO_ID = -(1 << 63)


def _banded(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [t or b"" for t in text_bytes(batch.column("text"))]
            keys, bands = [], []
            for text, (features, weights) in zip(texts, weighted_sets(texts, idf), strict=True):
                if not len(features):
                    bands.append(None)
                    keys.append(None)
                    continue
                lanes = sampled(features, np.log(weights).astype(np.float32)).reshape(BANDS, ROWS)
                bucket = np.arange(1, BANDS + 1, dtype=_U)
                for j in range(ROWS):
                    bucket = mix(bucket ^ lanes[:, j])
                bands.append(bucket.view(np.int64))
                keys.append(xxhash.xxh128_digest(b" ".join(text.split())))
            columns = [batch.column("_id"), batch.column("_hash"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_hash", "key", "bands"])

    return run


def _with_reference(docs: DataFrame) -> DataFrame:
    """`docs` with the columns _id and _hash; rows alike in both are one document.  A null id is the least number."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("_hash", F.xxhash64(F.col("text").cast("string")))


def found_classes(docs: DataFrame) -> DataFrame:
    """(_id, _hash, doc_id, class_id, class_size, kept): see `near_duplicates`.

    Rows are told apart by numbers of their own, given once and stored, so neither null nor repeated ids
    matter to what is linked."""
    docs = _with_reference(docs).select("_id", "_hash", F.col("text").cast("string").alias("text"))
    idf = inverse_frequencies(docs)
    signed = keep(docs.mapInArrow(_banded(idf), SIGNED).withColumn("row", F.monotonically_increasing_id()))
    copies = signed.where("key is not null").groupBy("key").agg(F.min("row").alias("id"))
    member = keep(signed.select("_id", "_hash", "row", "key").join(copies, "key", "left").withColumn("id", F.coalesce("id", "row")).drop("key"))
    met = signed.join(copies.select(F.col("id").alias("row")), "row", "left_semi").select(F.explode(F.array_distinct("bands")).alias("bucket"), F.col("row").alias("id"))

    def texts(ids: DataFrame) -> DataFrame:
        wanted = member.where("id = row").join(ids, "id", "left_semi").select("id", "_id", "_hash")
        return docs.join(wanted, ["_id", "_hash"]).dropDuplicates(["_id", "_hash"]).select("id", "text")

    linked = linkage.classes(met, texts, weighted_jaccard(idf), THRESHOLD, tokens(idf))
    member = member.join(linked, "id", "left").withColumn("root", F.coalesce("root", "id")).drop("id")
    first = F.struct((F.col("_id") == _NO_ID).alias("none"), "_id", "_hash", "row")
    best = member.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("class_size"))
    out = member.join(best, "root")
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select("_id", "_hash", known("_id").alias("doc_id"), known("first._id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, kept): one row for each row of `docs` (doc_id long, text string;
    other columns are ignored).

    class_id is the smallest doc_id of the class, null where no row of it has one.  One row of a class is
    kept: the one with the smallest doc_id, a null one last; of rows that share it the one with the
    smaller text hash; of equal rows any one.  Texts with the same words in the same order are always of
    one class.  Null texts, and texts without words, are classes of their own, each row by itself, and are
    kept.  Rows that share a doc_id but not the text are rows of their own.  An empty table gives an empty
    result.
    """
    return found_classes(docs).drop("_id", "_hash")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, that `near_duplicates` keeps.  Rows alike in doc_id and text are one
    document, of which one row stays, also where the text is null or has no words: the one with the least hash of its
    other columns (those of map type aside), so reruns agree."""
    stays = found_classes(docs).where("kept").select(F.col("_id").alias("_near_id"), F.col("_hash").alias("_near_hash"))
    names = ["_near_id", "_near_hash", "_near_rest"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    own_id, own_hash, rest = names
    others = [c for c in docs.columns if c not in ("doc_id", "text") and not docs.schema[c].dataType.typeName().startswith("map")]
    marked = docs.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), own_hash: F.xxhash64(F.col("text").cast("string")), rest: F.xxhash64(*[F.col(f"`{c}`") for c in sorted(others)], F.lit(0))})
    least = marked.groupBy(own_id, own_hash).agg(F.min(rest).alias(rest))
    stays = stays.withColumnsRenamed({"_near_id": own_id, "_near_hash": own_hash}).distinct().join(least, [own_id, own_hash])
    return marked.join(stays, names, "left_semi").dropDuplicates(names).drop(*names)
