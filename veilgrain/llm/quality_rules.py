"""Quality rules: plain counts with fixed limits, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed features of four families: three and four
consecutive characters (code points), single words and pairs of words.  A feature's value is
its share of its family, so length plays no part, and a text's margin is the sum of the families'
mean weights.  It is fitted on TRAIN_ROWS labelled rows at most, in one task, so that only the weights
reach the driver; one fold of them is kept apart to calibrate margins into probabilities (Platt).
That task gets no texts, but how often a text has each slot, counted where the text lies: FAMILIES x SLOTS
numbers of a text at most, whatever its length.  Scoring runs in Arrow batches against fixed thresholds,
and a text of more than LONG_BYTES is read in pieces.
"""

from __future__ import annotations

import codecs
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.labels import fold, labelled_texts
from veilgrain.llm.text import BLANKS, IS_BLANK, Words, chunks, mix, small_batches, text_bytes, windows_of, word_hashes

TRAIN_ROWS = 2000
SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
FAMILIES = 4
REJECT_BELOW, REVIEW_BELOW = 0.3, 0.7
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
STEPS, RATE, RIDGE = 80, 1.0, 1e-6
CALIBRATION_FOLD = 1
PART = 128  # rows handled together while fitting, which bounds its memory
LONG_BYTES = 1 << 20  # the size of a long text's pieces
_U = np.uint64

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, probability double, verdict string"
)


def counts_of(texts: list[bytes], words: Words) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of some texts, a row for each.  Windows of
    words are told apart by 64-bit hashes."""
    raw = np.frombuffer(words.data, dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(size + 1) - size - 1

    def within(marks: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return sums[last] - sums[first]

    chars = within(~IS_BLANK[raw] & ((raw & 0xC0) != 0x80), start, start + size)
    symbols = within(_IS_SYMBOL[raw], start, start + size)
    lines = [[x for x in t.split(b"\n") if x.strip(BLANKS)] for t in texts]
    again = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
    hashes, at = words.windows(WINDOW)
    owner = np.searchsorted(words.first, at, side="right").astype(_U)
    _, which, met = np.unique(hashes ^ mix(owner), return_inverse=True, return_counts=True)
    at = at[met[which] > 1]
    edges = np.bincount(at, minlength=len(words.hashes) + 1) - np.bincount(at + WINDOW, minlength=len(words.hashes) + 1)
    repeated = within(np.cumsum(edges)[:-1] > 0, words.first[:-1], words.first[1:])
    return np.stack([np.diff(words.first), chars, symbols, again, repeated], axis=1)


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The counts of one text."""
    return tuple(counts_of([text], Words([text]))[0].tolist())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


def features(texts: list[bytes], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts together: a family's slots in order, and where each text's part begins and ends
    (two rows).  The families follow each other."""
    if words.data.isascii():
        raw = np.frombuffer(words.data, dtype=np.uint8).astype(np.uint32)
        size = np.array([len(t) for t in texts], dtype=np.int64)
    else:
        said = [t.decode("utf-8", "replace") for t in texts]
        raw = np.frombuffer("\n".join(said).encode("utf-32-le", "replace"), dtype=np.uint32)
        size = np.array([len(t) for t in said], dtype=np.int64)
    start = np.cumsum(size + 1) - size - 1
    for n in CHARACTERS:
        yield _runs(raw, n), np.stack([start, start + np.maximum(size - n + 1, 0)])
    yield words.hashes >> _SHIFT, np.stack([words.first[:-1], words.first[1:]])
    yield _pairs(words.hashes), np.stack([words.first[:-1], np.maximum(words.first[1:] - 1, words.first[:-1])])


CHARACTERS = (3, 4)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_SHIFT = _U(64 - SLOT_BITS)


def _runs(raw: np.ndarray, n: int) -> np.ndarray:
    """Slots of every n code points in a row."""
    m = max(0, len(raw) - n + 1)
    h = raw[:m] * _FACTORS[0]
    for j in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + raw[j : j + m] * _FACTORS[j]
    h ^= h >> np.uint32(16)
    return (h * np.uint32(0x297A2D39)) >> np.uint32(32 - SLOT_BITS)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Slots of every two words in a row."""
    return mix(hashes[:-1] * _U(0xD6E8FEB86659FD93) + hashes[1:]) >> _SHIFT


def counts_of_long(text: bytes) -> np.ndarray:
    """What `counts_of` gives for one text, whose words' hashes and distinct lines are all that is held of it."""
    chars = symbols = 0
    for piece in _pieces(text):
        raw = np.frombuffer(piece, dtype=np.uint8)
        chars += int(np.count_nonzero(~IS_BLANK[raw] & ((raw & 0xC0) != 0x80)))
        symbols += int(np.count_nonzero(_IS_SYMBOL[raw]))
    lines, met = 0, set()
    for line in io.BytesIO(text):
        line = line.removesuffix(b"\n")
        if line.strip(BLANKS):
            lines += 1
            met.add(line)
    hashes = np.concatenate([np.zeros(0, _U), *word_hashes(_pieces(text))])
    windows = windows_of(hashes, WINDOW)
    again = np.sort(windows)
    again = np.unique(again[1:][again[1:] == again[:-1]])
    repeated = np.zeros(len(hashes), dtype=bool)
    for lo in range(0, len(windows) if len(again) else 0, LONG_BYTES):
        some = windows[lo : lo + LONG_BYTES]
        marks = again[np.minimum(np.searchsorted(again, some), len(again) - 1)] == some
        for j in range(WINDOW):
            repeated[lo + j : lo + j + len(some)] |= marks
    return np.array([len(hashes), chars, symbols, lines - len(met), int(np.count_nonzero(repeated))], dtype=np.int64)


def _pieces(text: bytes) -> Iterator[bytes]:
    return (text[at : at + LONG_BYTES] for at in range(0, len(text), LONG_BYTES))


def slots_of_long(text: bytes) -> np.ndarray:
    """How often each family (a row) has each slot in a text, which is read in pieces."""
    out = np.zeros((FAMILIES, SLOTS), dtype=np.int64)
    decoder, before = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for piece in chain(_pieces(text), [b""]):
        said = before + decoder.decode(piece, not piece)
        raw = np.frombuffer(said.encode("utf-32-le", "replace"), dtype=np.uint32)
        for family, n in enumerate(CHARACTERS):  # those that lie in what stood before are counted already
            out[family] += np.bincount(_runs(raw[max(0, len(before) - n + 1) :], n), minlength=SLOTS)
        before = said[-max(CHARACTERS) + 1 :]
    last = np.zeros(0, _U)
    for hashes in word_hashes(_pieces(text)):
        out[-2] += np.bincount((hashes >> _SHIFT).astype(np.int64), minlength=SLOTS)
        joined = np.concatenate([last, hashes])
        out[-1] += np.bincount(_pairs(joined).astype(np.int64), minlength=SLOTS)
        last = joined[-1:]
    return out


def is_long(texts: list[bytes]) -> bool:
    """A long text is a chunk of its own."""
    return len(texts) == 1 and len(texts[0]) > LONG_BYTES


def sparse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's slots (over all families), and how often it has them."""
    if is_long(texts):
        often = slots_of_long(texts[0]).ravel()
        own = np.flatnonzero(often)
        return [(own.astype(np.uint16), often[own].astype(np.int32))]
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for family, (slots, (lo, hi)) in enumerate(features(texts, Words(texts))):
        for i in range(len(texts)):
            own, count = np.unique(slots[lo[i] : hi[i]], return_counts=True)
            out[i].append(((own + family * SLOTS).astype(np.uint16), count.astype(np.int32)))
    return [tuple(np.concatenate([x[k] for x in rows]) for k in (0, 1)) for rows in out]


def shares(slots: np.ndarray, often: np.ndarray) -> np.ndarray:
    """How often a text has its slots, as shares of their families."""
    whole = np.bincount(slots >> SLOT_BITS, weights=often, minlength=FAMILIES)
    return (often / whole[slots >> SLOT_BITS]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # FAMILIES x SLOTS
    bias: float
    scale: float  # of calibration
    shift: float

    def margins(self, texts: list[bytes], words: Words | None) -> np.ndarray:
        """Without their words for one long text."""
        z = np.full(len(texts), self.bias)
        if words is None:
            often = slots_of_long(texts[0])
            return z + ((self.weights * often).sum(axis=1, dtype=np.float64) / np.maximum(1, often.sum(axis=1))).sum()
        for family, (slots, (lo, hi)) in enumerate(features(texts, words)):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[family][slots], dtype=np.float64)])
            z += (sums[hi] - sums[lo]) / np.maximum(1, hi - lo)
        return z

    def probabilities(self, texts: list[bytes], words: Words | None) -> np.ndarray:
        return sigmoid(self.scale * self.margins(texts, words) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def calibration(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's scale and shift by Newton steps, with his smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(theta @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target) + 1e-6 * theta)
        theta = theta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


FITTED = "weights binary, bias double, scale double, shift double"


SLOT_ROWS = "doc_id long, label int, hash long, slots binary, often binary"


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of rows (doc_id, label, hash, text), a row of 0.4 MB at most for each text."""
    for batch in small_batches(batches):
        for start, some in chunks(text_bytes(batch.column("text"))):
            own = sparse(some)
            made = [pa.array([x[k].tobytes() for x in own], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.slice(start, len(some)).columns[:3], *made], [x.split()[0] for x in SLOT_ROWS.split(", ")])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (doc_id, label, fold, slots, often); no row where they don't show both classes."""
    found = []
    for batch in batches:
        for i, label, part, slots, often in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "fold", "slots", "often")), strict=True):
            own = np.frombuffer(slots, dtype=np.uint16)
            found.append((i, label, part, own, shares(own, np.frombuffer(often, dtype=np.int32))))
    if not found:
        return
    found.sort(key=lambda x: x[0])
    y, part = np.array([x[1] for x in found], dtype=np.float64), np.array([x[2] for x in found])
    model = _trained([x[3:] for x in found], y, part != CALIBRATION_FOLD)
    if model:
        columns = [pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (model.bias, model.scale, model.shift))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FITTED.split(", ")])


def _trained(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, own: np.ndarray) -> Model | None:
    """Fitted on the rows `own`, calibrated on the others."""
    if len(set(y[own])) < 2:
        return None
    parts = [(i, min(i + PART, len(y))) for i in range(0, len(y), PART)]

    def margins_of(w: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, where their entries end, the entries' slots and shares, and the rows' sums of weights by shares."""
        for lo, hi in parts:
            ends = np.concatenate([[0], np.cumsum([len(x) for x, _ in rows[lo:hi]])])
            slots, own = (np.concatenate([x[k] for x in rows[lo:hi]]) for k in (0, 1))
            sums = np.concatenate([[0.0], np.cumsum(w[slots] * own)])
            yield slice(lo, hi), ends, slots, own, sums[ends[1:]] - sums[ends[:-1]]

    n, prior = own.sum(), y[own].mean()
    w, bias = np.zeros(FAMILIES * SLOTS), float(np.log(prior / (1 - prior)))
    balance = own * np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior)) / n  # rows kept for calibration have none
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):  # Adam over all rows
        slope, whole = RIDGE * w, 0.0
        for at, ends, slots, own_shares, sums in margins_of(w):
            error = balance[at] * (sigmoid(sums + bias) - y[at])
            slope += np.bincount(slots, weights=own_shares * np.repeat(error, np.diff(ends)), minlength=len(w))
            whole += error.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        bias -= 0.5 * whole
    model = Model(w.reshape(FAMILIES, SLOTS).astype(np.float32), float(bias), 1.0, 0.0)
    z = np.concatenate([found[-1] for found in margins_of(w)]) + bias
    apart = ~own if len(set(y[~own])) == 2 else own
    model.scale, model.shift = calibration(z[apart], y[apart])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """None where the labelled rows don't show both classes."""
    texts = labelled_texts(docs, labels, label, TRAIN_ROWS).select("doc_id", "label", F.xxhash64("text").alias("hash"), "text")
    rows = texts.mapInArrow(_slot_rows, SLOT_ROWS).groupBy("doc_id", "label").agg(F.min_by(F.struct("slots", "often"), "hash").alias("x"))  # one text of an id, as in `training_rows`
    found = rows.select("doc_id", "label", fold().alias("fold"), "x.*").repartition(1).mapInArrow(_fit_rows, FITTED).first()
    return Model(np.frombuffer(found.weights, dtype=np.float32).reshape(FAMILIES, SLOTS), found.bias, found.scale, found.shift) if found else None


def _judged(model: Model | None, texts: list[bytes]) -> tuple[np.ndarray, list[bool], np.ndarray]:
    """Counts, base_failed and probabilities of some texts."""
    stats, p = [np.zeros((0, 5), dtype=np.int64)], [np.zeros(0)]
    for _, some in chunks(texts):
        words = None if is_long(some) else Words(some)
        stats.append(counts_of(some, words) if words else counts_of_long(some[0])[None])
        p.append(model.probabilities(some, words) if model else np.ones(len(some)))
    whole = np.concatenate(stats)
    return whole, [base_failed(int(s[0]), int(s[4])) for s in whole], np.concatenate(p)


def _scorer(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            stats, failed, p = _judged(model, [t or b"" for t in text_bytes(batch.column("text"))])
            verdict = ["reject" if f or x < REJECT_BELOW else "review" if x < REVIEW_BELOW else "keep" for f, x in zip(failed, p, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(stats[:, k], pa.int64()) for k in range(5)), pa.array(failed, pa.bool_()), pa.array([v != "reject" for v in verdict], pa.bool_()), pa.array(p, pa.float64()), pa.array(verdict, pa.string())],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns are ignored): counts of the whole
    text, base_failed, probability of quality 1, verdict and kept.

    Null texts count as empty: no words, so base_failed.  Without labelled rows of both classes every
    probability is 1 and the base limits decide alone.  An empty table gives an empty result; repeated
    rows each get a row.
    """
    model = fit(docs, labels)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scorer(model), SCHEMA)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, that the rules don't reject.  Rows are judged as they stream
    by, so nothing is shuffled or joined."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            _, failed, p = _judged(model, [t or b"" for t in text_bytes(batch.column("text"))])
            yield batch.filter(pa.array([not f and x >= REJECT_BELOW for f, x in zip(failed, p, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
