"""External induced suffix sorting with longest common prefixes.

The text's leftmost-S suffixes are named and sorted by recursion on the text of names, down to a text that is
sorted in memory; all other suffixes are then
induced from them, L before S, each in one sweep through a queue in the order of suffixes. The queue is a monotone
priority queue keyed by first symbol, then arrival: symbols form pages of bounded size, a page collects its entries
(suffix, common prefix with the entry before it) in memory and on disk and becomes a row of slots when the sweep
reaches it. The sweep takes all filled slots up to the first empty one at once: what they induce can only fall into
slots behind them, so a run of numpy operations does the work of as many queue operations. The common prefix of two
induced neighbours is one more than the least common prefix between their sources, kept as a running minimum for
each symbol. Arrays beyond `memory` bytes are files in a scratch folder of the task, gone when it ends.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from dataclasses import dataclass, field

import numpy as np

WINDOW, BLOCK = 1 << 16, 1 << 18
#: Of sorted suffixes in text order, each so-many-th is compared first.
SKIPS = (64, 8, 1)
#: Memory a symbol needs where the recursion ends in a sort in memory, and that of such a sort, as so many times `memory`.
BASE_BYTES, BASE_TIMES = 24, 4
_BIG = np.int32(1 << 30)


@dataclass
class Space:
    """Arrays in memory, or in files once they are large."""

    memory: int = 64 << 20
    folder: str | None = None
    made: int = 0

    def array(self, n: int, kind) -> np.ndarray:  # noqa: ANN001
        if n * np.dtype(kind).itemsize <= self.memory:
            return np.empty(n, kind)
        out = np.memmap(path := self.path(), dtype=kind, mode="w+", shape=(n,))
        os.unlink(path)  # the room is free again as soon as the array is
        return out.view(np.ndarray)

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="xsort-")
        self.made += 1
        return f"{self.folder}/{self.made}"

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None


@dataclass
class Queue:
    """Entries by page; within a page in the order of arrival. Full buffers go to one file a page."""

    space: Space
    edges: np.ndarray  # first key of each page, ascending
    kind: type  # of its numbers
    held: int = 0
    buffers: dict[int, list[np.ndarray]] = field(default_factory=dict)
    files: dict[int, str] = field(default_factory=dict)

    def push(self, key: np.ndarray, suffix: np.ndarray, lcp: np.ndarray) -> None:
        """key ascending."""
        rows = np.stack([key.astype(self.kind), suffix.astype(self.kind), lcp.astype(self.kind)], axis=1)
        page = np.searchsorted(self.edges, key, side="right") - 1
        cut = np.flatnonzero(np.diff(page)) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
            self.buffers.setdefault(int(page[a]), []).append(rows[a:z].copy())
        self.held += rows.nbytes
        if self.held > self.space.memory:
            for p, parts in self.buffers.items():
                self.files.setdefault(p, self.space.path())
                with open(self.files[p], "ab") as f:
                    for x in parts:
                        f.write(x.tobytes())
            self.buffers, self.held = {}, 0

    def pop(self, page: int) -> np.ndarray:
        parts = self.buffers.pop(page, [])
        self.held -= sum(x.nbytes for x in parts)
        if page in self.files:
            parts = [np.fromfile(path := self.files.pop(page), self.kind).reshape(-1, 3), *parts]
            os.unlink(path)
        return np.concatenate(parts) if parts else np.zeros((0, 3), self.kind)


def places(text: np.ndarray):  # noqa: ANN201
    """The kind of numbers that hold places and symbols of a text."""
    return np.int32 if len(text) < 1 << 31 else np.int64


def types(text: np.ndarray) -> np.ndarray:
    """True for S: the suffix is smaller than the next one. The last symbol is the only smallest one."""
    n, out, last = len(text), np.ones(len(text), bool), True
    for z in range(n - 1, 0, -BLOCK):  # from the end, in blocks
        a = max(0, z - BLOCK)
        x, y = np.asarray(text[a:z]), np.asarray(text[a + 1 : z + 1])
        known, at = x != y, np.arange(z - a, dtype=np.int32)
        at = np.minimum.accumulate(np.where(known, at, z - a)[::-1])[::-1]  # the next place that decides
        out[a:z] = np.append(x < y, last)[at]
        last = out[a]
    return out


def but_last(s: np.ndarray) -> np.ndarray:
    out = s.copy()
    out[-1] = False
    return out


def name(text: np.ndarray, s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, bool]:
    """Order-preserving numbers (from 0) of the substrings from each leftmost-S place to the next, and whether all differ.

    Symbols with their types are packed into 62-bit chunks; only substrings still equal look at the next chunk.
    """
    bits = int(text.max()).bit_length() + 1
    width = max(1, 62 // bits)
    kind = lms.dtype.type  # as narrow as places, for the arrays here are the largest of a sort
    end = np.append(lms[1:], kind(len(text) - 1))

    def chunk(i: np.ndarray, z: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(width):
            at = i + k
            on = at <= z
            at = np.minimum(at, len(text) - 1)
            out = (out << bits) | np.where(on, (text[at].astype(np.int64) << 1) | s[at], 0)
        return out

    rank = np.zeros(len(lms), kind)
    live, k = np.arange(len(lms), dtype=kind), 0
    while len(live):
        key = np.empty(len(live), np.int64)
        for a in range(0, len(live), BLOCK):
            some = live[a : a + BLOCK]
            key[a : a + BLOCK] = chunk(lms[some] + kind(k), end[some])
        order = (np.lexsort((key, rank[live])) if k else np.argsort(key, kind="stable")).astype(kind)
        key, live = key[order], live[order]
        r = rank[live]
        old, new = np.ones(len(live), bool), np.ones(len(live), bool)
        old[1:] = r[1:] != r[:-1]
        new[1:] = old[1:] | (key[1:] != key[:-1])
        del key, order
        first = np.flatnonzero(new).astype(kind)
        size = np.diff(first, append=kind(len(live)))
        r += np.repeat(first, size)
        r -= np.maximum.accumulate(np.where(old, np.arange(len(live), dtype=kind), kind(0)))
        rank[live] = r  # names are places of first equals, so that later splits fit in
        k += width
        again = np.repeat(size > 1, size) & (lms[live] + kind(k) <= end[live])
        live = np.sort(live[again])
    there = np.zeros(len(lms), bool)
    there[rank] = True
    number = np.cumsum(there, dtype=kind) - kind(1)
    return number[rank], bool(there.all())


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, least: np.ndarray | None = None) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to limit; least: lengths that are known to be equal."""
    n, out = len(text), np.zeros(len(a), np.int32) if least is None else least.astype(np.int32)
    per = 8 // text.itemsize  # symbols that one 64-bit word holds
    live = np.arange(len(a))
    if per > 1 and n >= per:
        words = np.lib.stride_tricks.as_strided(text.view(np.uint8)[:8].view(np.uint64), shape=(n - per + 1,), strides=(text.itemsize,))
        x, y, top = a + out, b + out, np.maximum(a, b) + out
        done = [live[:0]]
        while len(live):
            on = (top <= n - per) & (out[live] < limit)
            on[on] = words[x[on]] == words[y[on]]
            done.append(live[~on])
            live, x, y, top = live[on], x[on] + per, y[on] + per, top[on] + per
            out[live] += per
        live = np.concatenate(done)
    while len(live):  # symbol by symbol inside the last word
        x, y = a[live] + out[live], b[live] + out[live]
        on = (x < n) & (y < n) & (out[live] < limit)
        live, x, y = live[on], x[on], y[on]
        live = live[text[x] == text[y]]
        out[live] += 1
    return np.minimum(out, limit)


def neighbours(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """The common prefix of each leftmost-S suffix of the sorted `order` and the one before it, up to limit.

    If a suffix shares so many symbols with its neighbour that the leftmost-S place after the next one lies among them,
    the suffix d symbols later shares all but d with one that stands before it. So every SKIPS[0]-th is compared
    from its start, and the others from where the one before them leads.
    """
    m, kind = len(order), order.dtype.type
    by_place = np.argsort(order, kind="stable").astype(kind)
    place = order[by_place]
    before = order[by_place - kind(1)]
    before[by_place == 0] = -1
    after = np.append(place[1:], kind(len(text)))
    shared = np.zeros(m, np.int32)
    for k, skip in enumerate(SKIPS):
        t = np.arange(0, m, skip, dtype=kind)
        if k:
            t = t[t % SKIPS[k - 1] != 0]
        t = t[before[t] >= 0]
        if not len(t):
            continue
        least = None
        if k:
            lead = t - t % SKIPS[k - 1]
            least = np.where(shared[lead] > after[t] - place[lead], shared[lead] - (place[t] - place[lead]), 0)
        for a in range(0, len(t), WINDOW):
            some = t[a : a + WINDOW]
            shared[some] = common(text, before[some], place[some], limit, None if least is None else least[a : a + WINDOW])
    out = np.empty(m, np.int32)
    out[by_place] = shared
    return out


class _Least:
    """Range minima of one window."""

    def __init__(self, x: np.ndarray) -> None:
        self.rows = [x]
        while 2 ** len(self.rows) <= len(x):
            h, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-h], last[h:]))
        self.log = np.zeros(len(x) + 2, np.int8)
        self.log[2:] = np.floor(np.log2(np.arange(2, len(x) + 2)) + 1e-9)

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Minima of x[a:z], a < z."""
        out, level = np.empty(len(a), np.int32), self.log[z - a]
        for k, row in enumerate(self.rows):
            on = level == k
            if on.any():
                out[on] = np.minimum(row[a[on]], row[z[on] - (1 << k)])
        return out


def induce(text: np.ndarray, target: np.ndarray, flip: bool, seeds: np.ndarray, seed_lcp: np.ndarray | None, space: Space, limit: int) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes of the target type in order (falling if flip), with the common prefix of each and the one before it.

    seeds: sorted sources of the other kind, in the same direction; of equal first symbol they come after the targets.
    """
    top = int(text.max())
    key_of = (lambda c: top - c.astype(np.int64)) if flip else (lambda c: c.astype(np.int64))
    seed_key = key_of(text[seeds])
    n_target = np.zeros(top + 1, np.int64)
    block = max(BLOCK, top + 1)
    for a in range(0, len(text), block):
        n_target += np.bincount(text[a : a + block][target[a : a + block]], minlength=top + 1)
    n_target = n_target[::-1] if flip else n_target
    n_seed = np.bincount(seed_key, minlength=top + 1)
    per = n_target + n_seed
    page_slots = max(1, space.memory // 12)
    edges, load = [0], 0
    if top < 4096:
        for k in np.flatnonzero(per):
            if load and load + per[k] > page_slots:
                edges.append(int(k))
                load = 0
            load += int(per[k])
    else:
        total = np.cumsum(per)
        edges = np.unique(np.searchsorted(total, np.arange(0, total[-1], page_slots))).tolist()
        edges[0] = 0
    edges = np.array([*edges, top + 1])
    kind, short = places(text), np.int16 if limit < 1 << 15 else np.int32
    queue = Queue(space, edges[:-1], kind)
    with_lcp = seed_lcp is not None
    out, out_lcp = space.array(int(n_target.sum()), kind), space.array(int(n_target.sum()), short) if with_lcp else None
    done, least = 0, np.zeros(top + 1, np.int32)
    began = np.zeros(top + 1, bool)
    seed_at = np.concatenate([[0], np.cumsum(n_seed)])
    for page in range(len(edges) - 1):
        k0, k1 = int(edges[page]), int(edges[page + 1])
        start = np.concatenate([[0], np.cumsum(per[k0:k1])])
        slots = space.array(int(start[-1]), kind)
        slots[:] = -1
        lcp = space.array(int(start[-1]), short) if with_lcp else None
        head = start[:-1].copy()  # next free target slot of each key
        mine = slice(int(seed_at[k0]), int(seed_at[k1]))
        sk = seed_key[mine] - k0
        place = start[sk] + n_target[k0:k1][sk] + (np.arange(len(sk)) - (seed_at[k0:k1][sk] - seed_at[k0]))
        slots[place] = seeds[mine]
        is_seed = np.zeros(len(slots), bool)
        is_seed[place] = True
        if with_lcp:
            lcp[:] = 0
            lcp[place] = seed_lcp[mine]
            lead = np.flatnonzero(n_seed[k0:k1])
            lcp[start[lead] + n_target[k0:k1][lead]] = 0

        def put(key: np.ndarray, suffix: np.ndarray, common_: np.ndarray | None, k0=k0, head=head, slots=slots, lcp=lcp) -> None:  # noqa: ANN001
            """key ascending, within this page."""
            k = key - k0
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(k)))
            where = head[k] + np.arange(len(k)) - np.repeat(at, size)
            slots[where] = suffix
            if common_ is not None:
                lcp[where] = common_
            head[k[at]] += size

        got = queue.pop(page)
        if len(got):
            order = np.argsort(got[:, 0], kind="stable")
            put(got[order, 0], got[order, 1], got[order, 2] if with_lcp else None)
        cur, total, look = 0, len(slots), 1024
        while cur < total:
            part = np.asarray(slots[cur : cur + look])
            empty = part < 0
            m = int(empty.argmax()) if empty.any() else len(part)
            look = min(WINDOW, max(256, 4 * m))
            if not m:
                raise AssertionError("a suffix was not induced")
            part = part[:m]
            seed = is_seed[cur : cur + m]
            if with_lcp:
                ell = np.array(lcp[cur : cur + m], np.int32)
                seam = np.flatnonzero(seed & ~np.append(is_seed[cur - 1] if cur else True, seed[:-1]))
                if len(seam):  # first seeds after targets of their symbols
                    before = np.where(seam > 0, part[seam - 1], slots[cur - 1])
                    same = text[before] == text[part[seam]]
                    ell[seam[same]] = common(text, before[same], part[seam[same]], limit)
            own = part[~seed]
            out[done : done + len(own)] = own
            if with_lcp:
                out_lcp[done : done + len(own)] = lcp[cur : cur + m][~seed]
            done += len(own)
            src = np.flatnonzero(part > 0)
            pred = part[src] - 1
            on = target[pred]
            src, pred = src[on], pred[on]
            common_ = None
            if len(pred):
                key = key_of(text[pred])
                order = np.argsort(key.astype(np.uint16) if top < 65536 else key, kind="stable")
                key, src, pred = key[order], src[order], pred[order]
            if with_lcp:
                if len(pred):
                    rmq = _Least(ell)
                    first = np.ones(len(key), bool)
                    first[1:] = key[1:] != key[:-1]
                    prev = np.where(first, -1, np.append(-1, src[:-1]))
                    common_ = rmq.of(prev + 1, src + 1)
                    common_[first] = np.minimum(common_[first], least[key[first]])
                    common_ = np.minimum(common_ + 1, limit)
                    common_[first & ~began[key]] = 0
                    began[key] = True
                np.minimum(least, ell.min(), out=least)
                if len(pred):
                    last = np.append(first[1:], True)
                    tail = np.append(np.minimum.accumulate(ell[::-1])[::-1], _BIG)
                    least[key[last]] = tail[src[last] + 1]
            if len(pred):
                here = int(np.searchsorted(key, k1))
                if here:
                    put(key[:here], pred[:here], common_[:here] if with_lcp else None)
                if here < len(key):
                    queue.push(key[here:], pred[here:], common_[here:] if with_lcp else np.zeros(len(key) - here, np.int64))
            cur += m
    return out, out_lcp


def lms_order(text: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(types, leftmost-S places in the order of their suffixes, number of levels below)."""
    s = types(text)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(places(text))
    names, all_differ = name(text, s, lms)
    if all_differ:
        order = np.empty(len(lms), np.int64)
        order[names] = np.arange(len(lms))
    else:
        order = suffix_order(names.astype(np.int32), space)
    return s, lms[order], order


def doubling(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text that is small enough to be sorted in memory; suffixes already alone are left out."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= text[k:]
    order = np.argsort(key, kind="stable")
    q = key[order]
    new = np.append(True, q[1:] != q[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    step = width
    alone = new & np.append(new[1:], True)
    live = order[~alone]  # in the order of their ranks, equals together
    while len(live):
        r, nxt = rank[live], rank[np.minimum(live + step, n)]
        by = np.lexsort((nxt, r))
        live, r, nxt = live[by], r[by], nxt[by]
        old = np.append(True, r[1:] != r[:-1])
        new = old | np.append(True, nxt[1:] != nxt[:-1])
        at = np.arange(len(live))
        rank[live] = r + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        live = live[~(new & np.append(new[1:], True))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def suffix_order(text: np.ndarray, space: Space) -> np.ndarray:
    """The suffix array of a text whose last symbol is its only smallest one."""
    if len(text) <= max(1, space.memory * BASE_TIMES // BASE_BYTES):
        return doubling(text)
    s, seeds, _ = lms_order(text, space)
    small, _ = induce(text, ~s, False, seeds, None, space, 0)
    large, _ = induce(text, but_last(s), True, np.asarray(small)[::-1], None, space, 0)
    large = np.append(np.asarray(large), len(text) - 1)[::-1]
    top = int(text.max()) + 1
    at_l = np.bincount(text[small], minlength=top)
    at_s = np.bincount(text[large], minlength=top)
    start = np.cumsum(at_l + at_s) - (at_l + at_s)
    out = np.empty(len(text), np.int64)
    cl, cs = text[small], text[large]
    out[start[cl] + np.arange(len(small)) - (np.cumsum(at_l) - at_l)[cl]] = small
    out[start[cs] + at_l[cs] + np.arange(len(large)) - (np.cumsum(at_s) - at_s)[cs]] = large
    return out


def repeated(text: np.ndarray, span: int, memory: int = 64 << 20) -> np.ndarray:
    """True for each place whose suffix shares at least span symbols with another one. text: positive integers."""
    out = np.zeros(len(text) + 1, bool)
    if len(text) <= span:
        return out[:-1]
    space = Space(memory)
    try:
        full = space.array(len(text) + 1, text.dtype)
        full[:-1] = text
        full[-1] = 0
        s, seeds, _ = lms_order(full, space)
        seed_lcp = neighbours(full, seeds, span)
        small, small_lcp = induce(full, ~s, False, seeds, seed_lcp, space, span)
        falling = np.zeros(len(small), np.int32)
        falling[1:] = np.asarray(small_lcp)[::-1][:-1]
        large, large_lcp = induce(full, but_last(s), True, np.asarray(small)[::-1], falling, space, span)
        for suffix, lcp in ((small, small_lcp), (large, large_lcp)):
            hit = np.flatnonzero(lcp >= span)
            out[suffix[hit]] = out[suffix[hit - 1]] = True
        # where the last L and the first S of a symbol meet
        l_last = _last_of(full, small)
        s_last = _last_of(full, large)
        both = [c for c in l_last if c in s_last]
        if both:
            a, b = np.array([l_last[c] for c in both]), np.array([s_last[c] for c in both])
            hit = common(full, a, b, span) >= span
            out[a[hit]] = out[b[hit]] = True
        return out[:-1]
    finally:
        space.close()


def _last_of(text: np.ndarray, suffixes: np.ndarray) -> dict[int, int]:
    """The last suffix of each first symbol (suffixes of one symbol stand together)."""
    if not len(suffixes):
        return {}
    c = text[suffixes]
    at = np.append(np.flatnonzero(c[1:] != c[:-1]), len(c) - 1)
    return dict(zip(c[at].tolist(), np.asarray(suffixes)[at].tolist(), strict=True))
