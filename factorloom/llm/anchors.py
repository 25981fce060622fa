"""Content-chosen anchors: where a repeated string of `span` bytes must share a shorter gram with its equal.

Every window of `span` bytes picks its smallest gram of `gram` bytes by hash (leftmost of equals). Equal windows
pick the same gram at the same offset, so windows only need to be compared within groups of one gram hash.
Neighbouring windows mostly pick the same gram; such a run of windows is one anchor, and the bytes they cover
are its context.

Units are bytes, or words where data holds their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import _BASE, _INVERSE, _TABLE, mix, powers

#: Bytes worked on at once, at some hundred bytes of memory each; a place in them fits PLACE bits.
PIECE, PLACE = 1 << 19, np.uint64(22)
_PLACES = np.uint64((1 << 22) - 1)


def pieces(offsets: np.ndarray, span: int, limit: int = PIECE) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last); a long row comes in pieces that share span-1 bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1), n)
        a, z = int(offsets[i]), int(offsets[j])
        if z - a <= 2 * limit:
            yield i, j, a, z
        else:
            for b in range(a, max(a + 1, z - span + 1), limit):
                yield i, j, b, min(b + limit + span - 1, z)
        i = j


def anchors(data: np.ndarray, offsets: np.ndarray, gram: int, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per piece: (row, first start in the row, number of starts, gram hash, context hash) of each anchor."""
    for i, j, a, z in pieces(offsets, span):
        part, at = data[a:z], np.clip(offsets[i : j + 1] - a, 0, z - a)
        n = len(part)
        if n < span:
            continue
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((part if part.dtype == np.uint64 else _TABLE[part]) * powers(int(_BASE), n), out=run[1:])
        inverse = powers(int(_INVERSE), n + 1)
        h = mix((run[gram:] - run[:-gram]) * inverse[: n - gram + 1])
        width = span - gram + 1
        key = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
        pad = -len(key) % width
        grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        total = n - span + 1
        least = np.minimum(back[:total], ahead[width - 1 : width - 1 + total])
        ok = np.ones(total + span, bool)  # no window crosses the end of a row
        for r in at[1:-1]:
            ok[max(0, r - span + 1) : r] = False
        starts = np.flatnonzero(ok[:total])
        if not len(starts):
            continue
        least = least[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        p = starts[first]
        g = (least[first] & _PLACES).astype(np.int64)
        e = p + count - 1 + span
        context = mix(mix((run[e] - run[p]) * inverse[p]) + (g - p).astype(np.uint64) * _BASE + (e - p).astype(np.uint64))
        row = np.searchsorted(at, p, side="right") - 1
        yield i + row, p + a - offsets[i + row], count, h[g], context
