"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are compared as lower-cased words with single blanks between them, in bytes.  An
item of m bytes may differ by k = floor(ERROR_SHARE * m) edits.  Cut into k + 1 pieces, at least one
piece survives any k edits unchanged, so an Aho-Corasick pass over all pieces finds every possible
place; each is verified with Myers' bit-parallel edit distance over the window in which the item
may end.  An item so short that its budget is zero must stand word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.license_scan import words_of
from veilgrain.llm.text import small_batches, text_bytes

ERROR_SHARE = 0.06
BLOCK_BYTES = 8 << 20  # items in one automaton; a larger benchmark has several, which rows pass one after another


def plain(text: bytes) -> bytes:
    return b" ".join(words_of(text))


def myers(pattern: bytes, masks: dict[int, int], text: bytes, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of `pattern` in `text`, if within `most` edits."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0) if m <= most else None
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # row 0 is free: a match may start anywhere
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, i + 1)
    return best


def masks_of(pattern: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Items (id, text) to look for."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = ERROR_SHARE):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            own = b" ".join(words)
            k = int(share * len(own)) or -1  # -1: whole words
            self.items.append((item, own, k, masks_of(own) if k >= 0 else {}))
            cuts = [len(own) * j // (max(k, 0) + 1) for j in range(max(k, 0) + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    pieces.setdefault(own[a:b].decode("latin-1"), []).append((len(self.items) - 1, a))
        self.automaton = ahocorasick.Automaton() if pieces else None
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()

    def found(self, text: bytes) -> dict[int, int]:
        """Item ids found in a text, with the least number of edits."""
        own = plain(text)
        if self.automaton is None or not own:
            return {}
        tried: dict[int, tuple[int, int]] = {}  # an item's last verified window
        out: dict[int, int] = {}
        for last, (size, at) in self.automaton.iter(own.decode("latin-1")):
            for index, offset in at:
                item, pattern, k, masks = self.items[index]
                start = last - size + 1 - offset  # where the item starts if nothing before was inserted
                if k < 0:
                    if (not start or own[start - 1] == 32) and (last + 1 == len(own) or own[last + 1] == 32):
                        out[item] = 0
                    continue
                low, high = max(0, start - k), start + len(pattern) + k
                known = tried.get(index, (0, -1))
                if out.get(item) == 0 or known[0] <= low and high <= known[1]:
                    continue
                tried[index] = (low, high)
                best = myers(pattern, masks, own[low:high], k)
                if best and best[0] < out.get(item, k + 1):
                    out[item] = best[0]
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """(item_id, text) pairs in blocks of about BLOCK_BYTES; the benchmark's size is measured first."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        yield sorted(zip(rows.column("item_id").to_pylist(), [x.encode() for x in rows.column("text").to_pylist()], strict=True))


_FOUND = "doc_id long, text string, item_ids array<long>, edits array<int>"


def _searcher(items: list[tuple[int, bytes]], share: float):
    """Adds what a block's items find to each row's item_ids and edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, share)
        for batch in small_batches(batches):
            found = []
            for text, ids, edits in zip(text_bytes(batch.column("text")), batch.column("item_ids").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                own = dict(zip(ids, edits, strict=True))
                for item, k in matcher.found(text or b"").items():
                    own[item] = min(k, own.get(item, k))
                found.append(own)
            lists = [pa.array([list(x.keys()) for x in found], pa.list_(pa.int64())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *lists], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns are ignored): whether the text holds
    an item of `benchmark` (item_id, text), which ones, and the least number of edits.

    The benchmark is the stated query set.  Its size is measured first: it is sent to the tasks in blocks of
    up to BLOCK_BYTES, and rows stream through one search for each block, so nothing is shuffled or
    joined and every row stays a row of its own, whatever its id.  Null texts, null items and items without
    words match nothing; an item id that repeats stands for each of its texts.
    """
    found = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(array() as array<long>) item_ids", "cast(array() as array<int>) edits")
    for items in item_blocks(benchmark):
        found = found.mapInArrow(_searcher(items, share), _FOUND)
    size = F.size("item_ids").cast("long")
    return found.select("doc_id", (size > 0).alias("contaminated"), size.alias("n_items"), F.array_sort("item_ids").alias("item_ids"), F.array_min("edits").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """The rows of `docs`, with all columns, that hold no item of `benchmark`.  Rows stream through one
    search for each block of items, so nothing is shuffled or joined."""
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: list[tuple[int, bytes]] = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, share)
            for batch in small_batches(batches):
                yield batch.filter(pa.array([not matcher.found(t or b"") for t in text_bytes(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
