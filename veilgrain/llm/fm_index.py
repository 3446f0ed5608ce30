"""A compressed full-text index: Burrows-Wheeler transform, wavelet matrix, backward search.

The text is a sequence of symbols 1..sigma with 0 as a separator.  Suffixes are sorted by their first
DEPTH symbols, which is enough to search for patterns shorter than that: intervals of such patterns
are unions of whole ties.  The transform is kept as one bit vector for each bit of a symbol, with a
popcount directory, so a rank takes a few array reads for each level; searches run over many
patterns at once.
"""

from __future__ import annotations

import numpy as np

DEPTH = 32


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits among the first i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            bits = (symbols >> level) & 1
            zeros = len(symbols) - int(bits.sum())
            self.levels.append((level, Bits(bits), zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i."""
        low = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            r, s = bits.ones(i), bits.ones(low)
            i, low = np.where(one, zeros + r, i - r), np.where(one, zeros + s, low - s)
        return i - low


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b)."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


class Index:
    """Index of `text` (int64, 0 separates) for patterns of `length` symbols; `order` is a number for each
    position of the text."""

    def __init__(self, text: np.ndarray, order: np.ndarray, length: int):
        if not 16 < length < DEPTH:
            raise ValueError(f"patterns have 17 to {DEPTH - 1} symbols")
        n = len(text)
        shifted = lambda r, k: np.concatenate([r[k:] + 1, np.zeros(min(k, n), dtype=np.int64)])
        rank, depth, at16 = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, None
        while depth < DEPTH:
            rank = _ranked(rank, shifted(rank, depth))
            depth *= 2
            at16 = rank if depth == 16 else at16
        suffixes = np.argsort(rank, kind="stable")
        sigma = int(text.max(initial=0))
        self.matrix = WaveletMatrix(text[suffixes - 1], sigma)  # text[-1] is a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.length = length
        short, full = (_ranked(at16, shifted(at16, k - 16))[suffixes] for k in (length - 1, length))
        self.shorter = self._groups(short)  # where suffixes share all symbols of a pattern but the last
        begin = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
        self.least = np.repeat(np.minimum.reduceat(order[suffixes], begin), np.diff(np.append(begin, n)))

    @staticmethod
    def _groups(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
        size = np.diff(np.append(begin, len(classes)))
        return np.repeat(begin, size).astype(np.int32), np.repeat(begin + size, size).astype(np.int32)  # a shard has fewer symbols than that

    def statistics(self, text: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, cut at the pattern length, of the pieces text[ends - sizes : ends], streamed
        from right to left: for each position whose match reaches the full length, the piece, the
        position, the number of occurrences and the least `order` among them."""
        found: list[tuple[np.ndarray, ...]] = []
        live = np.arange(len(ends))
        lo, hi, reach = np.zeros(len(ends), np.int64), np.full(len(ends), len(text), np.int64), np.zeros(len(ends), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = live[sizes[live] >= step]
            at = ends[live] - step
            long = reach[live] == self.length
            full = live[long]
            lo[full], hi[full] = self.shorter[0][lo[full]], self.shorter[1][lo[full]]
            symbol = text[at]
            lo[live] = self.first[symbol] + self.matrix.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.matrix.rank(symbol, hi[live])
            dead = live[hi[live] <= lo[live]]  # can't happen to pieces of the indexed text
            lo[dead], hi[dead] = 0, len(text)
            reach[live] = np.minimum(reach[live] + 1, self.length)
            reach[dead] = 0
            done = reach[live] == self.length
            own = live[done]
            found.append((own, at[done], hi[own] - lo[own], self.least[lo[own]]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
