"""Hashes of the words of many texts at once, in numpy.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a sum of random numbers, one for each byte value and
place, mixed with its length: no two words fall together by their make. Words of over ``LONG_WORD`` bytes are hashed by
blake2b.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

LONG_WORD = 64
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True

#: Two hashes of a word.
PAIR = np.dtype([("first", np.uint64), ("second", np.uint64)])

_powers: list[np.ndarray] = []


@lru_cache
def _random(k: int) -> np.ndarray:
    """Random numbers by place and byte, for the k-th hash."""
    return np.random.default_rng([20_231, k]).integers(0, 2**64, LONG_WORD * 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK)
        _powers[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _INVERSE)]
    return _powers


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word; text k has the bytes offsets[k] to offsets[k + 1]."""
    n = len(data)
    word = ~_GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, text


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int = 1) -> np.ndarray:
    """The first n independent hashes of each word, one row for each hash."""
    out = np.zeros((n, len(starts)), np.uint64)
    size = ends - starts
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _BLOCK, side="right")))
        short = lo + np.flatnonzero(size[lo:hi] <= LONG_WORD)
        if len(short):
            before = np.cumsum(size[short]) - size[short]
            at = np.arange(before[-1] + size[short[-1]]) - np.repeat(before, size[short])
            byte = data[at + np.repeat(starts[short], size[short])]
            at *= 256
            at += byte
            for k in range(n):
                out[k, short] = np.add.reduceat(_random(k)[at], before) ^ size[short].astype(np.uint64)
        for k in lo + np.flatnonzero(size[lo:hi] > LONG_WORD):
            out[:, k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8 * n).digest(), np.uint64)
        lo = hi
    return mix(out)


def pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent hashes of each word, side by side."""
    return np.ascontiguousarray(hashes(data, starts, ends, 2).T).reshape(-1).view(PAIR)


def numbered(words: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal pairs get one number from 1 on, and how many there are."""
    if not len(words):
        return np.zeros(0, np.int64), 0
    order = np.lexsort((words["second"], words["first"]))
    by = words[order]
    number = np.empty(len(words), np.int64)
    number[order] = np.cumsum(np.concatenate([[True], by[1:] != by[:-1]]))
    return number, int(number[order[-1]])


@lru_cache
def _weights(n: int) -> np.ndarray:
    return np.random.default_rng(4_127).integers(0, 2**64, n, np.uint64) | np.uint64(1)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive hashes, by order; each place has a random weight."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k, weight in enumerate(_weights(n)):
        total += words[k : len(words) - n + 1 + k] * weight
    return mix(total)
