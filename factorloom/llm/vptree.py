"""Vantage-point trees over 64-bit fingerprints under Hamming distance, in numpy.

An inner node holds a vantage point and a radius mu: points at distance <= mu go in, the others out. A query
of radius r at distance d may skip the inner side if d - r > mu and the outer side if d + r <= mu, by the
triangle inequality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BUCKET = 64


@dataclass
class Tree:
    vantage: list[int]
    mu: list[int]
    inner: list[int]  # child node, or -1 - leaf
    outer: list[int]
    leaves: list[np.ndarray]
    root: int = 0


def distance(points: np.ndarray, q: int | np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(q) if np.isscalar(q) else points ^ q)


def build(points: np.ndarray, bucket: int = BUCKET, max_leaves: int | None = None, seed: int = 7) -> Tree:
    """A tree over distinct points; leaves hold indices into them. Splits at the median distance from a vantage point."""
    rng = np.random.Generator(np.random.PCG64(seed))
    t = Tree([], [], [], [], [])

    def leaf(idx: np.ndarray) -> int:
        t.leaves.append(idx)
        return -len(t.leaves)

    def node(idx: np.ndarray, leaves: int | None) -> int:
        if len(idx) <= bucket or leaves == 1:
            return leaf(idx)
        own = points[idx]
        best = None
        for v in own[rng.integers(0, len(own), 4)]:  # the candidate whose distances spread most
            d = distance(own, v)
            mu = int(np.median(d))
            mu -= mu == d.max()
            near = np.count_nonzero((d >= mu - 1) & (d <= mu + 2))
            if best is None or near < best[0]:
                best = (near, v, mu, d)
        _, v, mu, d = best
        inside = d <= mu
        if inside.all() or not inside.any():
            return leaf(idx)
        k = len(t.vantage)
        t.vantage.append(int(v))
        t.mu.append(mu)
        t.inner.append(0)
        t.outer.append(0)
        t.inner[k] = node(idx[inside], None if leaves is None else leaves - leaves // 2)
        t.outer[k] = node(idx[~inside], None if leaves is None else leaves // 2)
        return k

    t.root = node(np.arange(len(points)), max_leaves)
    return t


def reach(t: Tree, q: np.ndarray, r: int) -> list[tuple[int, np.ndarray]]:
    """For each leaf, the queries (indices into q) whose ball of radius r may meet it; r = 0 gives each its home."""
    out, stack = [], [(t.root, np.arange(len(q)))]
    while stack:
        at, idx = stack.pop()
        if not len(idx):
            continue
        if at < 0:
            out.append((-1 - at, idx))
            continue
        d = distance(q[idx], t.vantage[at]).astype(np.int64)
        stack.append((t.inner[at], idx[d - r <= t.mu[at]]))
        stack.append((t.outer[at], idx[d + r > t.mu[at]]))
    return out


def pairs(points: np.ndarray, q: np.ndarray, r: int, bucket: int = BUCKET):  # noqa: ANN201
    """Yields (query indices, point indices) of all pairs within r, leaf by leaf."""
    t = build(points, bucket)
    for leaf, idx in reach(t, q, r):
        own = t.leaves[leaf]
        for k in range(0, len(idx), 4096):
            some = idx[k : k + 4096]
            a, b = np.nonzero(np.bitwise_count(q[some][:, None] ^ points[own][None, :]) <= r)
            yield some[a], own[b]
