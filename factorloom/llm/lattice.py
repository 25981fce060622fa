"""Piece lattices of many words at once, in numpy: Viterbi, marginals, second-best gaps, and exact N-best by A*.

Spaces stand for the vocabulary's space mark. Nodes are byte places of a word (0 .. its length); an edge is a
piece between two of them. Where no one-character piece fits, an edge of the unknown piece spans the character.

Many short words are swept place by place, all at once; a few long ones edge by edge. A byte of a word costs about 200 bytes
of memory and a few microseconds for usual pieces, up to 1,000 bytes of memory where pieces of all lengths fit.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .words import _BASE, _TABLE, mix

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_SLOTS, _SHIFT = 1 << 19, 64 - 19
NONE, PREFIX = -1, -2


@dataclass
class Vocab:
    pieces: list[bytes]  # by id, with spaces for marks; empty for control pieces
    scores: np.ndarray
    unknown: int
    byte_ids: np.ndarray  # id of each byte's piece, or -1
    longest: int = 0
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    unknown_score: float = 0.0

    def __post_init__(self) -> None:
        own = [(p, i) for i, p in enumerate(self.pieces) if p and i not in set(self.byte_ids.tolist())]
        if any(b" " in p.lstrip(b" ") for p, _ in own):
            raise ValueError("a piece that crosses from a word into a space is not supported")
        self.longest = max((len(p) for p, _ in own), default=1)
        whole = dict(own)
        known = dict.fromkeys((p[:k] for p, _ in own for k in range(1, len(p) + 1)), PREFIX) | whole
        self.slots, self.ids = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, NONE, np.int32)
        data = np.frombuffer(b"".join(known), np.uint8)
        sizes = np.array([len(p) for p in known], np.int64)
        starts, h = np.cumsum(sizes) - sizes, np.zeros(len(known), np.uint64)
        for k in range(self.longest):
            on = sizes > k
            h[on] = extend(h[on], data[starts[on] + k], k)
        for x, i in zip(h.tolist(), known.values(), strict=True):
            at = x >> _SHIFT
            while self.ids[at] != NONE:
                at = (at + 1) % _SLOTS
            self.slots[at], self.ids[at] = x, i
        self.unknown_score = float(min(self.scores)) - UNKNOWN_PENALTY

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes; PREFIX for what only begins a piece, NONE for anything else."""
        at = (h >> np.uint64(_SHIFT)).astype(np.int64)
        out = np.where(self.slots[at] == h, self.ids[at], NONE)
        left = np.flatnonzero((out == NONE) & (self.ids[at] != NONE))
        at = at[left]
        while len(left):
            at = (at + 1) % _SLOTS
            same = self.slots[at] == h[left]
            out[left[same]] = self.ids[at[same]]
            on = ~same & (self.ids[at] != NONE)
            left, at = left[on], at[on]
        return out


def extend(h: np.ndarray, byte: np.ndarray, k: int) -> np.ndarray:
    """The hash of a string from that of its first k bytes and its next byte."""
    return mix(h * _BASE + _TABLE[byte] + np.uint64(k))


def load_vocab(path: str) -> Vocab:
    """Pieces and scores of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids, pieces = np.full(256, -1, np.int32), []
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            pieces.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(p.replace(MARK, " ").encode())
    return Vocab(pieces, np.array([sp.get_score(i) for i in range(n)], np.float64), sp.unk_id(), byte_ids)


@dataclass
class Lattice:
    """Edges of all words, sorted by the place of their end in the word, then by word and start (so the longest comes first)."""

    base: np.ndarray  # node 0 of each word; node k is base + k
    length: np.ndarray
    word: np.ndarray  # of each edge
    place: np.ndarray  # where it starts in the word
    src: np.ndarray  # nodes
    dst: np.ndarray
    piece: np.ndarray
    group: np.ndarray  # first edge of each node that has edges, in edge order
    cuts: np.ndarray  # groups at each place, as ranges of `group`


def build(vocab: Vocab, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Lattice:
    """The lattice of the words data[starts:ends]."""
    length = ends - starts
    base = np.concatenate([[0], np.cumsum(length + 1)[:-1]]).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(starts), dtype=np.int32), length)
    k = (np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)  # place in the word
    at = starts[word] + k
    lead = (data[at] & 0xC0) != 0x80
    word, k, at = word[lead], k[lead], at[lead]
    room = (length[word] - k).astype(np.int32)
    parts = []
    first = data[at]
    size = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))).astype(np.int32)
    size = np.minimum(size, room)
    single = np.zeros(len(at), bool)
    live, h = np.arange(len(at), dtype=np.int32), np.zeros(len(at), np.uint64)
    for n in range(1, vocab.longest + 1):  # down the trie, as long as some piece begins so
        on = room[live] >= n
        live, h = live[on], h[on]
        if not len(live):
            break
        h = extend(h, data[at[live] + (n - 1)], n - 1)
        ids = vocab.find(h)
        hit = ids >= 0
        some = live[hit]
        single[some[size[some] == n]] = True
        parts.append((word[some], k[some], k[some] + np.int32(n), ids[hit]))
        on = ids != NONE
        live, h = live[on], h[on]
    lost = np.flatnonzero(~single)
    parts.append((word[lost], k[lost], k[lost] + size[lost], np.full(len(lost), vocab.unknown, np.int32)))
    w, a, z, p = (np.concatenate(x[::-1]) for x in zip(*parts, strict=True))  # the longest pieces first
    order = np.argsort(z.astype(np.int64) << np.int64(40) | base[w] + z, kind="stable")
    w, a, z, p = w[order], a[order], z[order], p[order]
    src, dst = base[w] + a, base[w] + z
    new = np.ones(len(dst), bool)
    new[1:] = dst[1:] != dst[:-1]
    group = np.flatnonzero(new)
    places = z[group]
    return Lattice(base, length, w, a, src, dst, p, group, np.searchsorted(places, np.arange(1, (int(places[-1]) if len(places) else 0) + 2)))


#: Below so many edges a place, sweeps go edge by edge; edges that become Python numbers at once.
_THIN, _BLOCK = 32, 1 << 16


def _edge_blocks(*columns: np.ndarray) -> Iterator[tuple]:
    """Rows of equally long columns as Python numbers, in bounded blocks."""
    for a in range(0, len(columns[0]), _BLOCK):
        yield from zip(*(c[a : a + _BLOCK].tolist() for c in columns), strict=True)


def _accumulate(values: np.ndarray, source: np.ndarray, target: np.ndarray, score: np.ndarray, marginal: bool) -> np.ndarray:
    """values[target] = best or log-sum of values[source] + score, edge by edge in the given order."""
    out, floor = values.tolist(), -math.inf
    if not marginal:
        for s, t, x in _edge_blocks(source, target, score):
            x += out[s]
            if x > out[t]:
                out[t] = x
        return np.array(out)
    for s, t, x in _edge_blocks(source, target, score):
        x, y = x + out[s], out[t]
        if x < y:
            x, y = y, x
        out[t] = x if y == floor else x + math.log1p(math.exp(y - x))
    return np.array(out)


def _sweep(lat: Lattice, score: np.ndarray, marginal: bool) -> np.ndarray:
    """Forward scores of all nodes: best path, or log of the sum over paths."""
    nodes = int(lat.base[-1] + lat.length[-1] + 1) if len(lat.base) else 0
    alpha = np.full(nodes, -np.inf)
    alpha[lat.base] = 0.0
    if len(lat.src) < _THIN * len(lat.cuts):
        return _accumulate(alpha, lat.src, lat.dst, score, marginal)
    bounds = np.append(lat.group, len(lat.src))
    for lo, hi in zip(lat.cuts[:-1].tolist(), lat.cuts[1:].tolist(), strict=True):
        if lo == hi:
            continue
        a, z = bounds[lo], bounds[hi]
        v = alpha[lat.src[a:z]] + score[a:z]
        g = bounds[lo:hi] - a
        best = np.maximum.reduceat(v, g)
        if marginal:
            safe = np.where(np.isfinite(best), best, 0)
            best = safe + np.log(np.add.reduceat(np.exp(v - np.repeat(safe, np.diff(np.append(g, z - a)))), g))
        alpha[lat.dst[a + g]] = best
    return alpha


def forward(lat: Lattice, score: np.ndarray, marginal: bool = False) -> np.ndarray:
    return _sweep(lat, score, marginal)


def totals(lat: Lattice, alpha: np.ndarray) -> np.ndarray:
    return alpha[lat.base + lat.length]


def best_edges(lat: Lattice, score: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """For each node the first edge that reaches its forward score (the longest last piece wins ties), or -1."""
    out = np.full(len(alpha), -1, np.int64)
    on = np.flatnonzero(alpha[lat.src] + score == alpha[lat.dst])
    out[lat.dst[on[::-1]]] = on[::-1]
    return out


def best_paths(lat: Lattice, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges of all best paths, word after word from its start; number of edges of each word)."""
    words, cur = np.arange(len(lat.base)), lat.base + lat.length
    if len(lat.src) < _THIN * len(lat.cuts):
        paths = [_trace(lat, back, int(a), int(z)) for a, z in zip(lat.base, cur, strict=True)]
        return np.concatenate([np.zeros(0, np.int64), *paths]), np.array([len(x) for x in paths], np.int64)
    edges, owner = [], []
    while True:
        on = cur > lat.base[words]
        words, cur = words[on], cur[on]
        if not len(words):
            break
        e = back[cur]
        edges.append(e)
        owner.append(words)
        cur = lat.src[e]
    if not edges:
        return np.zeros(0, np.int64), np.zeros(len(lat.base), np.int64)
    e, w = np.concatenate(edges[::-1]), np.concatenate(owner[::-1])
    return e[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(lat.base))


def _trace(lat: Lattice, back: np.ndarray, start: int, node: int) -> np.ndarray:
    path, src = [], lat.src
    while node > start:
        path.append(e := int(back[node]))
        node = int(src[e])
    return np.array(path[::-1], np.int64)


def _from_start(lat: Lattice) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Edges by falling start in the word, and the ranges of equal starts."""
    key = -lat.place.astype(np.int64) if len(lat.place) and lat.place.max() > 65535 else (65535 - lat.place).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(lat.place[order])) + 1
    return order, [(a, z) for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True) if a < z]


def _backward(lat: Lattice, score: np.ndarray, marginal: bool) -> np.ndarray:
    """Best path, or log of the sum over paths, from each node to the end of its word."""
    beta = np.full(int(lat.base[-1] + lat.length[-1] + 1) if len(lat.base) else 0, -np.inf)
    beta[lat.base + lat.length] = 0.0
    order, ranges = _from_start(lat)
    src, dst, s = lat.src[order], lat.dst[order], score[order]
    if len(order) < _THIN * len(ranges):
        return _accumulate(beta, dst, src, s, marginal)
    join = np.logaddexp if marginal else np.maximum
    for a, z in ranges:
        join.at(beta, src[a:z], beta[dst[a:z]] + s[a:z])
    return beta


def backward(lat: Lattice, score: np.ndarray) -> np.ndarray:
    return _backward(lat, score, True)


def gaps(lat: Lattice, score: np.ndarray, alpha: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Best minus second-best score of each word (inf where there is one segmentation): another path has an edge off the best one, so the second best is the best path through one."""
    beta = _backward(lat, score, False)
    off = np.ones(len(lat.src), bool)
    off[path] = False
    second = np.full(len(lat.base), -np.inf)
    e = np.flatnonzero(off)
    np.maximum.at(second, lat.word[e], alpha[lat.src[e]] + score[e] + beta[lat.dst[e]])
    return totals(lat, alpha) - second


#: Hypotheses that wait before those behind the n best go.
_KEPT = 64


def n_best(lat: Lattice, score: np.ndarray, alpha: np.ndarray, word: int, n: int, into: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[float, list[int]]]:
    """The n best (score, pieces) of one word. A* runs from the end; the forward Viterbi score of a node is the
    exact cost still to come, so hypotheses leave the heap in the order of their final scores.

    Of equal scores the newest goes on, so ties run straight to the start instead of side by side. A node is left n times
    at most: every later hypothesis there has n at least as good ones before it, with the same best way to the start.
    into: edges_into(lat), for many words of one lattice.
    """
    start, end = int(lat.base[word]), int(lat.base[word] + lat.length[word])
    heap, found, tick, left = [(-float(alpha[end]), 0, end, 0.0, None)], [], 0, {}
    first, last = into or edges_into(lat)
    while heap and len(found) < n:
        f, _, node, done, tail = heapq.heappop(heap)
        if node == start:
            path = []
            while tail:
                path.append(tail[0])
                tail = tail[1]
            found.append((-f, path))
            continue
        left[node] = left.get(node, 0) + 1
        if left[node] > n:
            continue
        for e in range(int(last[node]) - 1, int(first[node]) - 1, -1):  # the longest piece is the newest
            src, g = int(lat.src[e]), done + float(score[e])
            if alpha[src] > -np.inf:
                tick -= 1
                heapq.heappush(heap, (-(g + float(alpha[src])), tick, src, g, (int(lat.piece[e]), tail)))
        if len(heap) > _KEPT + 4 * n:  # each stands for a path of exactly its score, so those behind n others aren't needed
            heap = heapq.nsmallest(n, heap)
    return found


def edges_into(lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """The range of incoming edges of each node."""
    nodes = int(lat.base[-1] + lat.length[-1] + 1) if len(lat.base) else 0
    first, last = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    at = lat.dst[lat.group]
    first[at], last[at] = lat.group, np.append(lat.group[1:], len(lat.dst))
    return first, last
