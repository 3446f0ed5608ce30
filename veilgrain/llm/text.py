"""Words, and hashes of words, of whole batches of texts at once.

Texts are handled as UTF-8 bytes.  `bytes.split()` cuts at exactly the six ASCII blanks
(space and 09-0D), so it yields the words `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLANKS = b" \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"  # in Spark's and DuckDB's regular expressions
CHUNK_BYTES = 128 << 10  # texts handled together, so that arrays stay in the cache; a longer text is a chunk of its own

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of `x`."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _BASE)
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[list(BLANKS)] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, dtype=_U)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of values[first:last], one for each pair, by prefix sums."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U))


def windows_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """What `rolling` gives for every k values in a row, without its prefix sums."""
    out = np.zeros(max(0, len(hashes) - k + 1), dtype=_U)
    for j in range(k if len(out) else 0):
        out += hashes[j : j + len(out)] * powers(k)[0][j]
    out += _U(k)
    return mix(out)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK_BYTES, each with the index of its first text; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > CHUNK_BYTES:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield start, held


class Words:
    """The words of some texts: `hashes`, byte offsets `starts` and `ends` in `data`, and `first`,
    where text i has the words first[i] up to first[i + 1]."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        blank = IS_BLANK[raw]
        word = ~blank
        edge = np.ones(len(raw), dtype=bool)
        edge[1:] = blank[:-1]
        self.starts = np.flatnonzero(word & edge)
        edge[:-1] = blank[1:]
        edge[-1:] = True
        self.ends = np.flatnonzero(word & edge) + 1
        self.hashes = rolling(_BYTE_VALUE[raw], self.starts, self.ends) if len(raw) else np.zeros(0, _U)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.first = np.searchsorted(self.starts, at)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one text, and the index of each one's first word."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        text_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.flatnonzero(text_of[: n - k + 1] == text_of[k - 1 :])
        return rolling(self.hashes, at, at + k), at


def word_hashes(pieces: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the words of a text that comes in pieces, wherever it is cut: for each piece those of the words
    that end in it, and at last that of a word that ends with the text."""
    value, size = 0, 0  # of the word that isn't at its end yet

    def begun(part: bytes) -> int:
        raw = np.frombuffer(part, dtype=np.uint8)
        return int((_BYTE_VALUE[raw] * powers(len(raw))[0]).sum(dtype=_U))

    def ended() -> np.ndarray:
        return mix(np.array([(value + size) % (1 << 64)], dtype=_U))

    for piece in pieces:
        words, out = Words([piece]), []
        first, last = 0, len(words.hashes)
        if size and not (last and words.starts[0] == 0):
            out.append(ended())
            value, size = 0, 0
        elif size:
            first, end = 1, int(words.ends[0])
            value, size = value + pow(int(_BASE), size, 1 << 64) * begun(piece[:end]), size + end
            if end < len(piece):
                out.append(ended())
                value, size = 0, 0
        if first < last and words.ends[-1] == len(piece):
            last, start = last - 1, int(words.starts[-1])
            value, size = begun(piece[start:]), len(piece) - start
        yield np.concatenate([*out, words.hashes[first:last]])
    if size:
        yield ended()


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small_batches(batches: Iterable[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, so that very long texts don't pile up."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
