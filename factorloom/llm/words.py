"""Vectorised words over raw UTF-8 bytes: positions, and 64-bit hashes of words and word runs."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes of the letter-or-digit rule: 0-9, a-z (after lower-casing) and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEGMENT = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def lower(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return _LOWER[data]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, _SEGMENT + 1024)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; a word never crosses from one row to the next."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = inside[cuts[:-1]] if len(data) else np.zeros(0, bool)
    return cuts[:-1][keep], cuts[1:][keep]


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, by differences of a running sum; memory is bounded by segments."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + _SEGMENT)))
        size = int(ends[j - 1] - a)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_TABLE[data[a : a + size]] * powers(int(_BASE), size), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * powers(int(_INVERSE), size + 1)[s]
        i = j
    return mix(out)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive word hashes: entry i is for words i .. i+size-1."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _BASE + h[k : k + n]
    return mix(out)
