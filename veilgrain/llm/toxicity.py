"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding disguises.

Folding takes the compatibility form (full-width and mathematical letters become plain ones), drops
combining marks and characters without width, lower-cases, maps look-alike letters of other scripts
to Latin ones and digits to the letters they stand for; i and l fold together, as 1 stands for both.
The lexicon's terms are whole words or beginnings of words.  They are learned, with their weights,
from at most TRAIN_ROWS labelled rows (the bound of what reaches the driver), near copies counted
once: a term is kept if it is seen in enough toxic texts and hardly ever in others; of terms that
contain each other the longest with the same support stays.  A text's evidence is the weighted number
of matches outside exception phrases over the square root of its length, calibrated into a probability
on one fold of rows that the lexicon isn't learned from.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.labels import FOLDS, fold, training_rows
from veilgrain.llm.quality_rules import CALIBRATION_FOLD, calibration, sigmoid
from veilgrain.llm.scratch import keep
from veilgrain.llm.text import small_batches

TRAIN_ROWS = 8000
STEM_LENGTHS = range(4, 9)
LEAST_SUPPORT, LEAST_SHARE, LEAST_PRECISION = 5, 0.006, 0.9
PREDICT_FROM = 0.5
SKETCH = 3

# Look-alikes and digit substitutions.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "ı": "i",
    "һ": "h", "ӏ": "i", "ү": "y", "ѡ": "w", "ѵ": "v", "ԍ": "g", "г": "r", "п": "n", "и": "u", "ш": "w", "з": "e", "η": "n", "ω": "w", "γ": "y", "β": "b", "σ": "o",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "յ": "j", "ց": "g", "զ": "q", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ɢ": "g", "ʜ": "h",
    "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "i", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ø": "o", "đ": "d", "ł": "i", "ħ": "h",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
# Phrases in which a term is no insult.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash truck", "trash day", "clown fish", "circus clown", "class clown", "idiot proof", "idiot light", "pond scum", "soap scum",
    "sore loser", "moron test", "crap shoot", "pig farm", "guinea pig", "rat race", "lab rat", "snake plant", "worm farm", "dumb bell", "dumb waiter", "stupid mistake", "garbage collection", "garbage collector", "garbage truck",
)

_TABLE = str.maketrans(HOMOGLYPHS | DIGITS | {"l": "i"})
_INNER_SIGN = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[\u0300-\u036f\u0483-\u0489\u20d0-\u20ff\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")  # marks and characters without width


def folded(text: str) -> str:
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    if "@" in text or "$" in text:
        text = _INNER_SIGN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text.lower().translate(_TABLE)


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)  # whole words, folded
    stems: dict[str, float] = field(default_factory=dict)  # beginnings of words, folded
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: float = 1.0
    shift: float = -3.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found: dict[str, list[tuple[str, float, int]]] = {}
        for kind, terms in (("word", self.words), ("stem", self.stems), ("exception", {folded(x): 0.0 for x in self.exceptions})):
            for term, weight in terms.items():
                found.setdefault(term, []).append((kind, weight, len(term)))
        if not self.words and not self.stems:
            return None
        built = ahocorasick.Automaton()
        for term, kinds in found.items():
            built.add_word(term, kinds)
        built.make_automaton()
        return built


def evidence(text: str, automaton: ahocorasick.Automaton | None) -> float:
    """Weighted matches over the square root of the number of words (and ten)."""
    if automaton is None or not text:
        return 0.0
    t = folded(text)
    hits, excused = [], []
    for last, kinds in automaton.iter(t):
        for kind, weight, size in kinds:
            start = last - size + 1
            if start and t[start - 1].isalnum():
                continue
            ends = last + 1 == len(t) or not t[last + 1].isalnum()
            if kind == "exception":
                if ends:
                    excused.append((start, last))
            elif ends or kind == "stem":
                hits.append((start, last, weight))
    if not hits:
        return 0.0
    excused.sort()
    starts, reach = [x for x, _ in excused], []  # reach: the last end of the phrases that begin up to here
    for _, y in excused:
        reach.append(max(y, reach[-1]) if reach else y)
    total = sum(w for a, b, w in hits if not (k := bisect_right(starts, a)) or reach[k - 1] < b)
    return total / (len(text.split()) + 10) ** 0.5


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct folded tokens, and a sketch by which near copies are known."""
    for batch in small_batches(batches):
        tokens, sketches = [], []
        for text in batch.column("text").to_pylist():
            own = _TOKEN.findall(folded(text or ""))
            grams = {" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))}
            sketches.append([min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in range(SKETCH)])
            tokens.append(sorted({x for x in own if 3 <= len(x) <= 30}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(tokens, pa.list_(pa.string())), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "label", "tokens", "sketch"]
        )


def _keys(tokens: list[str]) -> set[tuple[bool, str]]:
    """Terms that a text shows: whole words (True) and stems (False)."""
    out = {(True, x) for x in tokens}
    for x in tokens:
        out.update((False, x[:n]) for n in STEM_LENGTHS if len(x) > n)
    return out


def terms(rows: list[tuple[int, list[str]]]) -> Lexicon:
    """Terms and weights from (label, distinct tokens) rows."""
    toxic, others = [t for y, t in rows if y == 1], [t for y, t in rows if y == 0]
    seen: Counter = Counter()
    for tokens in toxic:
        seen.update(_keys(tokens))
    least = max(LEAST_SUPPORT, LEAST_SHARE * len(toxic))
    known = {k: c for k, c in seen.items() if c >= least}
    clean: Counter = Counter()
    for tokens in others:
        clean.update(k for k in _keys(tokens) if k in known)
    known = {k: c for k, c in known.items() if c / (c + clean[k]) >= LEAST_PRECISION}
    longer: dict[str, int] = {}  # the most support that a longer term with this beginning has
    for (_, x), c in known.items():
        for n in range(STEM_LENGTHS.start, len(x)):
            longer[x[:n]] = max(longer.get(x[:n], 0), c)
    out = Lexicon()
    for (whole, x), c in sorted(known.items(), key=lambda k: (len(k[0][1]), not k[0][0], k[0][1])):
        if any(x[:n] in out.stems for n in range(STEM_LENGTHS.start, len(x) + 1)):
            continue
        if not whole and (longer.get(x, 0) >= c or known.get((True, x), 0) >= c):
            continue
        weight = float(np.log((c + 0.5) / (len(toxic) + 1)) - np.log((clean[(whole, x)] + 0.5) / (len(others) + 1)))
        (out.words if whole else out.stems)[x] = weight
    return out


def _evidences(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in small_batches(batches):
            found = pa.array([evidence(t or "", automaton) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], [batch.schema.names[0], batch.schema.names[1], "evidence"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Lexicon:
    """An empty lexicon, which scores every text alike, where the labelled rows don't show both classes.  Terms
    are learned from all folds but CALIBRATION_FOLD, unless that leaves one class alone."""
    rows = keep(training_rows(docs, labels, label, TRAIN_ROWS))
    table = rows.select("doc_id", "label", "text").mapInArrow(_tokens, "doc_id long, label int, tokens array<string>, sketch array<long>").toArrow().sort_by([("doc_id", "ascending")])
    met: set[tuple[int, int]] = set()
    own = []
    for i, y, tokens, sketch in zip(*(table.column(c).to_pylist() for c in ("doc_id", "label", "tokens", "sketch")), strict=True):
        known = set(enumerate(sketch))
        if not known & met:
            own.append((y, tokens, zlib.crc32(str(i).encode()) % FOLDS))
        met |= known
    if len({y for y, *_ in own}) < 2:
        return Lexicon()
    taught = [(y, t) for y, t, k in own if k != CALIBRATION_FOLD]
    apart = len({y for y, _ in taught}) == 2 and len({y for y, _, k in own if k == CALIBRATION_FOLD}) == 2
    lexicon = terms(taught if apart else [(y, t) for y, t, _ in own])
    judged = rows.where(F.col("fold") == CALIBRATION_FOLD) if apart else rows
    found = judged.select("doc_id", "label", "text").mapInArrow(_evidences(lexicon), "doc_id long, label int, evidence double").toArrow()
    lexicon.scale, lexicon.shift = calibration(found.column("evidence").to_numpy(), found.column("label").to_numpy().astype(np.float64))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each row of `docs` (doc_id, text; other
    columns are ignored).  Null and empty texts have no evidence and get the score of a clean text;
    repeated rows each get a row; an empty table gives an empty result."""
    own = docs.selectExpr("cast(doc_id as long) doc_id", "0 as spare", "cast(text as string) text")
    found = own.mapInArrow(_evidences(lexicon), "doc_id long, spare int, evidence double")
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(lexicon.scale) * F.col("evidence") + F.lit(lexicon.shift)))
    scored = found.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"), "evidence")


__all__ = ["Lexicon", "evidence", "fit", "folded", "score", "sigmoid", "terms"]
