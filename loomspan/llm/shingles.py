"""Word shingles of texts as sorted 64-bit hashes, computed over flat bytes."""

from __future__ import annotations

import numpy as np

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_LETTER = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them."""
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        n = 1 << max(16, n.bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(flat: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text) of flat UTF-8 bytes; starts has one entry more than texts."""
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    b = _LOWER[flat] if lower else flat
    space = _SPACE[b]
    inside = np.zeros(len(b) + 1, bool)
    inside[:-1] = ~space
    begins = inside[:-1].copy()
    begins[1:] &= space[:-1]
    edge = starts[(starts > 0) & (starts < len(b))]
    begins[edge] = ~space[edge]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    ends = inside[:-1].copy()
    ends[:-1] &= space[1:]
    last = edge - 1
    ends[last] = ~space[last]
    to = np.flatnonzero(ends) + 1
    up, down = _power(len(b) + 1)
    upto = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LETTER[b] * up[: len(b)], out=upto[1:])
    words = mixed((upto[to] - upto[at]) * down[at] + (to - at).astype(np.uint64))
    return words, np.searchsorted(at, starts)


def shingle_sets(flat: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; a shorter text with words is one shingle."""
    words, before = word_hashes(flat, starts)
    n = len(words)
    out = []
    if n >= k:
        joined = words[: n - k + 1].copy()
        for j in range(1, k):
            joined = mixed(joined * np.uint64(3)) + words[j : n - k + 1 + j]
        joined = mixed(joined)
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(joined[lo : hi - k + 1]))
        elif hi > lo:
            h = np.array([hi - lo], np.uint64)
            for j in range(lo, hi):
                h = mixed(h * _BASE + words[j : j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    n = np.array([len(tokens)], np.uint64)
    a = mixed(mixed(tokens).sum(dtype=np.uint64, keepdims=True) + n * _G)
    b = mixed((mixed(tokens ^ _M2) * _M1).sum(dtype=np.uint64, keepdims=True) ^ n)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])
