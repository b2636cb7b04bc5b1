"""A compressed full-text index over integer symbols, with vectorised backward search.

The text's suffixes are ordered by their first ``DEPTH`` symbols. The transform (the symbol before each suffix) is
held in a wavelet matrix: one bit per symbol and level, with running counts per 64 bits. A backward step maps the
two ends of an interval through the levels, so many patterns step together as numpy arrays. Bounded order is
enough for patterns up to ``DEPTH``: all rows before an interval are smaller in its first symbols.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.bits = len(symbols), max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            one = (now >> level) & 1 == 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = one
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(self.n - one.sum()))
            now = np.concatenate([now[~one], now[one]])
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)
            at = np.where((symbol >> (self.bits - 1 - level)) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.begin[symbol]


def _doubled(symbols: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(order of the suffixes by DEPTH symbols, ranks of all substrings of length 2**k)."""
    rank, ranks, size = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1, {}, 1
    ranks[1] = rank
    while size < DEPTH:
        rank = _joined(rank, rank, size)
        size *= 2
        ranks[size] = rank
    return np.argsort(rank, kind="stable"), ranks


def _joined(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of the strings made of ``first`` at i and ``second`` at i + shift; 0 stands for the end."""
    later = np.zeros(len(second), np.int64)
    later[: max(0, len(second) - shift)] = second[shift:]
    return np.unique(first * (len(first) + 1) + later, return_inverse=True)[1].astype(np.int64) + 1


class FMIndex:
    """Of texts in a row, each followed by a symbol 0; symbols are from 1 to sigma - 1."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        order, self._ranks = _doubled(symbols)
        self.order, self.n = order, len(symbols)
        self.matrix = WaveletMatrix(symbols[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])

    def edges(self, length: int) -> np.ndarray:
        """Rows at which the first ``length`` symbols change, and the number of rows; ``length`` is up to DEPTH."""
        half = 1 << (length.bit_length() - 1)
        rank = self._ranks[half]
        if half < length:
            rank = _joined(rank, self._ranks[half], length - half)
        rank = rank[self.order]
        return np.concatenate([[0], np.flatnonzero(rank[1:] != rank[:-1]) + 1, [self.n]])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before them; empty where lo == hi."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        both += np.concatenate([self.first[symbol], self.first[symbol]])
        return both[: len(lo)], both[len(lo) :]

    def forget(self) -> None:
        """Drop what only building needs."""
        self._ranks = {}


def statistics(index: FMIndex, texts: list[np.ndarray], length: int):
    """Stream texts from right to left through the index.

    Yields (text, place, row) arrays: the texts' substrings of ``length`` symbols that the index holds, and a row of
    each one's interval. The matching length of a pattern is counted up to ``length`` only: an interval that has
    reached it is cut back to ``length - 1`` symbols before the next step. Where a step finds nothing, the pattern is
    shortened from its right until it does, as matching statistics ask for.
    """
    cut = {}

    def widened(lo: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in cut:
            cut[size] = index.edges(size)
        k = np.searchsorted(cut[size], lo, side="right") - 1
        return cut[size][k], cut[size][k + 1]

    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    left = np.asarray([len(texts[k]) for k in order])
    total = np.concatenate([[0], np.cumsum(left)])
    flat = np.concatenate([texts[k] for k in order]) if order else np.zeros(0, np.int64)
    at = left.copy()
    lo, hi, matched = np.zeros(len(order), np.int64), np.full(len(order), index.n), np.zeros(len(order), np.int64)
    live = int((at > 0).sum())
    names = np.asarray(order)
    while live:
        at[:live] -= 1
        symbol = flat[total[:live] + at[:live]]
        full = np.flatnonzero(matched[:live] == length)
        if len(full):
            lo[full], hi[full] = widened(lo[full], length - 1)
            matched[full] = length - 1
        new_lo, new_hi = index.step(symbol, lo[:live], hi[:live])
        empty = np.flatnonzero(new_lo >= new_hi)
        while len(empty):
            none = empty[matched[empty] == 0]
            new_lo[none], new_hi[none], matched[none] = 0, index.n, -1
            empty = empty[matched[empty] > 0]
            for size in np.unique(matched[empty]).tolist():
                some = empty[matched[empty] == size]
                lo[some], hi[some] = widened(lo[some], size - 1) if size > 1 else (0, index.n)
                matched[some] = size - 1
            new_lo[empty], new_hi[empty] = index.step(symbol[empty], lo[empty], hi[empty])
            empty = empty[new_lo[empty] >= new_hi[empty]]
        lo[:live], hi[:live] = new_lo, new_hi
        matched[:live] += 1
        hit = np.flatnonzero(matched[:live] == length)
        if len(hit):
            yield names[hit], at[hit], lo[hit]
        # texts are in falling order of length, so those that go on are the first
        live = int(np.searchsorted(-at, 0, side="left"))
