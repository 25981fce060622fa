"""Token counts under edits: a segment tree of pre-tokens for each document.

Leaves hold up to LEAF pre-tokens, nodes the characters and tokens below them. The token count of a text is the sum
over its pre-tokens, and a match of the pre-token pattern depends only on what follows its start, so an edit at a
place needs new pre-tokens from the first one whose end lies within CONTEXT characters before the edit until new and
old boundaries meet again behind it. Only these are encoded anew; sums change along the paths of the touched leaves.

Edits are (pos, removed, added) in code points, applied one after the other, each to the text as it is by then;
places beyond the text are moved to its end.

Defined results: null and empty texts have no pre-tokens; null edits are none; special-token strings are ordinary
text; repeated rows are counted alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, CONTEXT = 64, 4
#: Pre-tokens whose counts a worker remembers, and the longest that is remembered.
CACHED, CACHED_CHARS = 200_000, 64
RANKS_BYTES = 64 << 20


class Counter(dict):
    """Tokens of a pre-token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


_SPLIT = regex.compile(PATTERN)


class Tree:
    """Pre-tokens of one text with sums of characters and tokens."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.reencoded = counter, 0
        self._build(_SPLIT.findall(text))

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        if pieces:
            at = np.arange(0, len(pieces), LEAF)
            base = slice(self.width, self.width + len(at))
            self.chars[base] = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at)
            self.tokens[base] = np.add.reduceat(np.fromiter(map(self.counter.__getitem__, pieces), np.int64, len(pieces)), at)
        level = self.width
        while level > 1:
            half = slice(level // 2, level)
            for x in (self.chars, self.tokens):
                x[half] = x[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join("".join(x) for x in self.leaves)

    def pieces(self) -> int:
        return sum(map(len, self.leaves))

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character pos (the last one at the end), and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if pos >= before + self.chars[node] and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return node - self.width, before

    def _set(self, leaf: int, pieces: list[str], tokens: int) -> None:
        node = leaf + self.width
        chars, dt = sum(map(len, pieces)) - int(self.chars[node]), tokens - int(self.tokens[node])
        self.leaves[leaf] = pieces
        while node:
            self.chars[node] += chars
            self.tokens[node] += dt
            node //= 2

    def edit(self, pos: int, removed: int, added: str) -> None:
        size = int(self.chars[1])
        pos = min(max(pos, 0), size)
        end = min(pos + max(removed, 0), size)
        lo, lo_at = self._find(max(0, pos - CONTEXT))
        hi = self._find(max(end - 1, 0))[0]
        # the first pre-token that may change, walking back over leaves as long as none in hand ends early enough
        while True:
            old = self.leaves[lo]
            at, k = lo_at, 0
            while k < len(old) and at + len(old[k]) <= pos - CONTEXT:
                at += len(old[k])
                k += 1
            if k or lo == 0 or at == 0:
                break
            lo -= 1
            lo_at -= int(self.chars[lo + self.width])
        head, start = old[:k], at
        tail: list[str] = old[k:]
        last = lo
        while last < hi:
            last += 1
            tail = tail + self.leaves[last]
        known = int(sum(self.tokens[lo + self.width : last + self.width + 1]))
        before = "".join(tail)
        text = before[: pos - start] + added + before[end - start :]
        shift = len(added) - (end - pos)
        # boundaries of old pre-tokens behind the edit, in new places
        while True:
            bounds, at = {}, start
            for i, p in enumerate(tail):
                if at >= end:
                    bounds.setdefault(at + shift - start, i)
                at += len(p)
            bounds.setdefault(at + shift - start, len(tail))
            fresh, here, meet = [], 0, None
            whole = last + 1 == len(self.leaves) or not self.chars[last + 1 + self.width :].any()
            limit = len(text) if whole else max(0, len(text) - CONTEXT)
            for m in _SPLIT.finditer(text):
                if m.end() > limit and not (whole and m.end() == len(text)):
                    break
                fresh.append(m.group())
                here = m.end()
                if here in bounds and here >= pos - start + len(added):
                    meet = bounds[here]
                    break
            if meet is None and whole:
                meet = len(tail)
            if meet is not None:
                break
            last += 1  # not met yet: take one more leaf
            more = self.leaves[last]
            known += int(self.tokens[last + self.width])
            tail, text = tail + more, text + "".join(more)
        self.reencoded += len(fresh)
        gone = sum(map(self.counter.__getitem__, tail[:meet]))
        tokens = known - gone + sum(map(self.counter.__getitem__, fresh))
        new = head + fresh + tail[meet:]
        for leaf in range(lo + 1, last + 1):
            self._set(leaf, [], 0)
        self._set(lo, new, tokens)
        if len(new) > 8 * LEAF:
            self._build([p for x in self.leaves for p in x])


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    if Path(path).stat().st_size > RANKS_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count(docs: DataFrame, edits: Column, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_pretokens, n_tokens, n_tokens_edited, n_reencoded, n_chars_edited.

    edits: an array<struct<pos, removed, added>> expression over the columns of docs.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(held.value)
        for batch in batches:
            rows = []
            for text, todo in zip(batch.column(1), batch.column(2), strict=True):
                tree = Tree(text.as_py() or "", counter)
                n, tokens = tree.pieces(), tree.total
                for e in todo.as_py() or ():
                    if e is not None:
                        tree.edit(int(e["pos"] or 0), int(e["removed"] or 0), e["added"] or "")
                rows.append((n, tokens, tree.total, tree.reencoded, int(tree.chars[1])))
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in cols]], names=["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded", "n_chars_edited"])

    slim, _ = texts(docs, id_col, text_col, None, edits.alias("edits"))
    return slim.mapInArrow(scan, f"doc_id {kind}, n_pretokens long, n_tokens long, n_tokens_edited long, n_reencoded long, n_chars_edited long")


def sample_edits(text: Column) -> Column:
    """Three edits of every text: a word put first, seven characters out of the middle, five replaced at three quarters."""
    n = F.coalesce(F.length(text), F.lit(0))
    one = lambda pos, removed, added: F.struct(pos.cast("int").alias("pos"), F.lit(removed).alias("removed"), F.lit(added).alias("added"))
    return F.array(one(F.lit(0), 0, "Edited: "), one(F.floor(n / 2), 7, ""), one(F.floor(n * 3 / 4), 5, " it's Ωmega 42"))
