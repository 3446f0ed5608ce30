"""Line dedup: fuzzy lines by MinHash, verified, with one line kept for each component.

Lines are compared in lower-cased ASCII with single blanks.  A line's set is its runs of CHARACTERS
characters (the whole line, if shorter).  One hash of each run fills LANES bins with their least
values (one-permutation MinHash; empty bins borrow from others by hash), which make BANDS bands of
ROWS: two long lines at the threshold of 0.8 share a band with probability 0.995; short lines, whose
bins borrow, a little less often (README has the measured recall).  Lines sharing a band are
compared exactly (`linkage`), and similar lines form components by distributed union-find.  Equal
lines are one line, known by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm import linkage
from veilgrain.llm.scratch import keep
from veilgrain.llm.text import BLANKS, mix, small_batches, text_bytes

CHARACTERS, THRESHOLD = 6, 0.8
BANDS, ROWS = 10, 4
LANES = BANDS * ROWS
BATCH_BYTES = 256 << 10  # of text looked at together, so that arrays stay in the processor's cache
STRETCH = 500_000  # distinct lines a task remembers
_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def plain(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_id(line: bytes) -> int:
    """63 bits of a plain line's hash."""
    return xxhash.xxh3_64_intdigest(line) >> 1


def _packed(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every CHARACTERS characters of the joined lines as a number, and where the joined lines break.

    Latin-1 characters are packed as bytes, so the number is exact; what others have beyond a byte is
    hashed and added, so a run has one number whatever is around it."""
    joined = b"\n".join(lines)
    wide = None
    if not joined.isascii():
        said = joined.decode("utf-8", "replace")
        try:
            joined = said.encode("latin-1")
        except UnicodeEncodeError:
            wide = np.frombuffer(said.encode("utf-32-le"), dtype=np.uint32)
            joined = (wide & np.uint32(255)).astype(np.uint8).tobytes()
    breaks = np.flatnonzero(wide == 10) if wide is not None else np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 10)
    padded = joined + bytes(8)
    runs = np.ndarray(len(joined) + 1, dtype="<u8", buffer=padded, strides=(1,)) & _U((1 << 8 * CHARACTERS) - 1)
    if wide is not None:
        high = np.concatenate([wide >> np.uint32(8), np.zeros(CHARACTERS, dtype=np.uint32)]).astype(_U)
        more = np.zeros(len(runs), dtype=_U)
        for j in range(CHARACTERS):
            more = more * _U(0x100000001B3) + high[j : j + len(runs)]
        runs = np.where(more > 0, runs ^ mix(more), runs)
    return runs, breaks


def run_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of CHARACTERS characters of plain lines, and how many each line has."""
    runs, breaks = _packed(lines)
    ends = np.append(breaks, len(runs) - 1)
    start = np.append(0, breaks + 1)
    size = ends - start
    count = np.maximum(size - CHARACTERS + 1, 1)
    own = np.ones(len(runs), dtype=bool)
    for k in range(CHARACTERS):  # runs that would reach into the next line
        own[np.maximum(ends - k, 0)] = False
    own[start] = True
    h = runs[own]
    h *= _ODD[0]
    h ^= h >> _U(32)
    h *= _ODD[1]
    short = size < CHARACTERS  # their run would reach into the next line
    h[np.cumsum(count)[short] - 1] = [_U(line_id(lines[i])) for i in np.flatnonzero(short)]
    return h, count


def lanes_of(lines: list[bytes]) -> np.ndarray:
    """MinHash values of plain lines, a row for each."""
    if not lines:
        return np.zeros((0, LANES), dtype=_U)
    h, count = run_hashes(lines)
    cell = h >> _U(32)
    cell *= _U(LANES)
    cell >>= _U(32)
    cell += np.repeat(np.arange(len(lines), dtype=_U) * _U(LANES), count)
    out = np.full(len(lines) * LANES, ~_U(0))
    np.minimum.at(out, cell.view(np.int64), h)
    out = out.reshape(len(lines), LANES)
    full = out != ~_U(0)
    rows, bins = np.nonzero(~full)
    for attempt in range(1, 400):
        if not len(rows):
            break
        donor = (mix(bins.astype(_U) * _U(1000) + _U(attempt)) % _U(LANES)).astype(np.int64)
        ok = full[rows, donor]
        out[rows[ok], bins[ok]] = out[rows[ok], donor[ok]]
        rows, bins = rows[~ok], bins[~ok]
    return out


def buckets(lanes: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), (len(lanes), BANDS))
    grouped = lanes.reshape(len(lanes), BANDS, ROWS)
    for j in range(ROWS):
        key = mix(key ^ grouped[:, :, j])
    return key


def run_sets(lines: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct run hashes of each plain line, all of weight 1."""
    h, count = run_hashes(lines)
    ends = np.cumsum(count)
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    new = np.append(True, h[1:] != h[:-1])
    new[ends[:-1]] = True  # a line's first run is its own, whatever the line before ends with
    sets = np.split(h[new], np.cumsum(new)[ends[:-1] - 1])
    return [(x, np.ones(len(x))) for x in sets]


_PAIR_BITS = 19


def _keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (line, run) keys of plain lines, and the size of each line's set.  A run is known by 45 bits of
    its hash, so of a hundred million pairs of lines one has two different runs that look alike."""
    h, count = run_hashes(lines)
    h >>= _U(_PAIR_BITS)
    h |= np.repeat(np.arange(len(lines), dtype=_U) << _U(64 - _PAIR_BITS), count)
    h.sort()
    distinct = h[np.append(True, h[1:] != h[:-1])]
    return distinct, np.bincount((distinct >> _U(64 - _PAIR_BITS)).view(np.int64), minlength=len(lines))


def jaccard(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Similarities of pairs of plain lines."""
    out = [np.zeros(0)]
    for at in range(0, len(left), 1 << _PAIR_BITS):
        (x, nx), (y, ny) = _keys(left[at : at + (1 << _PAIR_BITS)]), _keys(right[at : at + (1 << _PAIR_BITS)])
        every = np.concatenate([x, y])
        every.sort()
        both = np.bincount((every[1:][every[1:] == every[:-1]] >> _U(64 - _PAIR_BITS)).view(np.int64), minlength=len(nx))
        out.append(both / (nx + ny - both))
    return np.concatenate(out)


def _lines(text: bytes | None) -> list[tuple[int, bytes]]:
    """(number, plain line) of the lines with a word; numbers count all lines."""
    if not text:
        return []
    low = text.lower()
    tidy = b"  " not in low and not any(c in low for c in (b"\t", b"\r", b"\x0b", b"\x0c"))
    lines = [x.strip(BLANKS) if tidy else b" ".join(x.split()) for x in low.split(b"\n")]
    return [(i, x) for i, x in enumerate(lines) if x]


SEEN = "id long, doc_id long, text_hash long, line int, buckets array<long>"


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence of a line; the first one in a stretch of a task's lines carries the line's buckets."""
    known: set[int] = set()
    for batch in small_batches(batches, BATCH_BYTES):
        ids, numbers, lengths, fresh, places = [], [], [], [], []
        for text in text_bytes(batch.column("text")):
            lines = _lines(text)
            hashes = [line_id(x) for _, x in lines]
            for k, h in enumerate(hashes):
                if h not in known:
                    known.add(h)
                    fresh.append(lines[k][1])
                    places.append(len(ids) + k)
            ids += hashes
            numbers += [i for i, _ in lines]
            lengths.append(len(lines))
        if len(known) > STRETCH:
            known.clear()
        size = np.zeros(len(ids) + 1, dtype=np.int32)
        size[np.array(places, dtype=np.int64) + 1] = BANDS
        keys = pa.array(buckets(lanes_of(fresh)).ravel().view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), keys)
        owners = [np.repeat(batch.column(c).to_numpy(), lengths) for c in ("doc_id", "text_hash")]
        columns = [pa.array(c, k) for c, k in zip((ids, *owners, numbers), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, lists], [x.split()[0] for x in SEEN.split(", ")])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) of the lines, once for each stretch."""
    known: set[int] = set()
    for batch in small_batches(batches):
        ids, lines = [], []
        for text in text_bytes(batch.column("text")):
            for _, x in _lines(text):
                h = line_id(x)
                if h not in known:
                    known.add(h)
                    ids.append(h)
                    lines.append(x)
        if len(known) > STRETCH:
            known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], ["id", "text"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        kept, lines, removed = [], [], []
        for text, gone in zip(text_bytes(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            drop, own = set(gone or ()), (text or b"").split(b"\n")
            kept.append(None if text is None else b"\n".join(x for i, x in enumerate(own) if i not in drop))
            lines.append(sum(1 for x in own if x.strip(BLANKS)))
            removed.append(len(drop))
        digest = [None if k is None else hashlib.sha256(k).hexdigest() for k in kept]
        columns = [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_removed", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, kept) for each row of `docs` (doc_id, text; other columns are ignored).

    n_lines counts lines with a word; of each component of similar lines the first in (doc_id, line)
    order stays.  `kept` is the remaining text, lines without a word included; it is left out without
    `with_text`.  A null text has no lines, and stays null, as does its digest.
    Rows alike in doc_id and text are one document and get the same result; of rows that share only the
    id the one with the smaller text hash comes first; null ids come first of all.  An empty table gives
    an empty result."""
    null_id = -(1 << 63)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    seen = keep(own.mapInArrow(_seen, SEEN))
    met = seen.select(F.explode("buckets").alias("bucket"), "id")
    seen = seen.drop("buckets")

    def texts(ids: DataFrame) -> DataFrame:
        return own.select("text").mapInArrow(_texts, "id long, text string").join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])

    roots = linkage.classes(met, texts, jaccard, THRESHOLD, run_sets)
    # Lines that occur once and are like no other stay; only the others need their first place.
    several = seen.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(None).cast("long").alias("root"))
    grouped = roots.join(roots.where("id <> root").select("root").distinct(), "root").select("id", "root")
    wanted = several.unionByName(grouped).groupBy("id").agg(F.max("root").alias("root"))
    place = F.struct("doc_id", "text_hash", "line")
    known = keep(seen.join(wanted.hint("shuffle_hash"), "id").select(F.coalesce("root", "id").alias("component"), "doc_id", "text_hash", "line"))
    first = known.groupBy("component").agg(F.min(place).alias("first"))
    ref = ["doc_id", "text_hash"]
    gone = known.join(first, "component").where(place != F.col("first")).groupBy(*ref).agg(F.collect_set("line").alias("gone"))
    out = own.join(gone, ref, "left").mapInArrow(_kept, "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept string")
    out = out if with_text else out.drop("kept")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != null_id, F.col("doc_id")))
