"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `size` consecutive words of an item (a shorter item is one window). As a set of shingles it is
contained in a document only if its rarest shingle is, so that one shingle is the whole necessary prefix at
containment 1. Pass 1 counts how often each item shingle occurs in all documents; pass 2 probes documents
with prefix shingles only. A probe at word p for a shingle at offset o of a window of n words stands for the
start p-o; the positional bound wants p-o >= 0 and the length bound p-o+n <= the document's words. What is
left is verified word by word on the bytes.

Items are taken in blocks of bounded bytes, so that what is broadcast is bounded however large the benchmark is. One block
is one scan of the documents, and nothing about them is shuffled but the counts of item shingles. Of several blocks one
is broadcast at a time; each leaves a table of the hits of the texts that have any, and these meet by two hashes of the text.

Defined results: a null or wordless text has no words, no hits and is clean; null item texts have no windows; an item
with a null item_id hits, but isn't counted or listed; an item_id may be of any type, and is listed as a string; equal
items hit together; repeated documents are judged one by one; very long texts are read whole, one at a time; an empty
benchmark leaves all clean; an empty table gives no rows; further columns are ignored or, with `carry`, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, schema_of, steps, text_bytes, text_of, texts, tidy
from .words import lower, run_hashes, word_bounds, word_hashes

WINDOW, SHINGLE = 13, 5
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 20


@dataclass
class Block:
    """The windows of one block of items, ready to be probed."""

    words: list[bytes]  # distinct item words
    starts: np.ndarray  # of each distinct window, into `seq`
    sizes: np.ndarray  # its words
    seq: np.ndarray  # word numbers of all items, one after the other
    seq_hash: np.ndarray  # their hashes
    owners: list[tuple[str, ...]] = field(default_factory=list)  # item_ids of each window
    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # shingle words -> sorted distinct hashes
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # -> sorted hash, first and last entry, entries (window, offset)


def _filter(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return bits


def build_block(items: list[tuple[str | None, str]], size: int, shingle: int) -> Block:
    items = [(i, t) for i, t in items if t]
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
    data = lower(data)
    s, e = word_bounds(data, offsets)
    h = word_hashes(data, s, e)
    owner = np.searchsorted(offsets, s, side="right") - 1
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    seq = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(s.tolist(), e.tolist(), strict=True)), np.int64, len(s))
    count = np.bincount(owner, minlength=len(items)) if len(s) else np.zeros(len(items), np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1].astype(np.int64)
    seen: dict[bytes, int] = {}
    starts, sizes, owners = [], [], []
    for k, (item, _) in enumerate(items):
        n = int(count[k])
        w = min(size, n)
        for a in range(first[k], first[k] + (n - w + 1 if n else 0)):
            key = seq[a : a + w].tobytes()
            if key not in seen:
                seen[key] = len(starts)
                starts.append(a)
                sizes.append(w)
                owners.append(set())
            if item is not None:
                owners[seen[key]].add(item)
    block = Block(list(number), np.array(starts, np.int64), np.array(sizes, np.int64), seq, h, [tuple(sorted(o)) for o in owners])
    for width in sorted({min(shingle, w) for w in sizes}):
        mine = np.flatnonzero(np.minimum(block.sizes, shingle) == width)
        runs = run_hashes(h, width)
        at = np.concatenate([np.arange(block.starts[w], block.starts[w] + block.sizes[w] - width + 1) for w in mine])
        block.shingles[width] = np.unique(runs[at])
    return block


def choose_prefixes(block: Block, counts: dict[int, np.ndarray], shingle: int) -> None:
    """Keep each window's rarest shingle (ties to the smaller hash, then the earlier offset)."""
    for width, known in block.shingles.items():
        mine = np.flatnonzero(np.minimum(block.sizes, shingle) == width)
        runs = run_hashes(block.seq_hash, width)
        rows = []
        for w in mine:
            here = runs[block.starts[w] : block.starts[w] + block.sizes[w] - width + 1]
            rank = counts[width][np.searchsorted(known, here)]
            o = np.lexsort((here, rank))[0]
            rows.append((here[o], w, o))
        hashes = np.array([r[0] for r in rows], np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes, entry = hashes[order], np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)[order]
        keys, at, n = np.unique(hashes, return_index=True, return_counts=True)
        block.prefix[width] = (keys, at, at + n, entry)


def _lookup(hashes: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `hashes` found in sorted `keys`, and which key."""
    if not len(keys) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(bits[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    k = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
    ok = keys[k] == hashes[at]
    return at[ok], k[ok]


def _tokenise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends, hashes, and the first word of each row (with an end)."""
    data = lower(data)
    s, e = word_bounds(data, offsets)
    return data, s, e, word_hashes(data, s, e), np.searchsorted(s, offsets)


def count_shingles(docs: DataFrame, text_col: str, block: Block) -> dict[int, np.ndarray]:
    """How often each item shingle occurs in all documents; at most one row an item shingle reaches the driver."""
    held = docs.sparkSession.sparkContext.broadcast(block.shingles)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        bits = {w: _filter(k) for w, k in known.items()}
        total = {w: np.zeros(len(k), np.int64) for w, k in known.items()}
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in steps(offsets):
                part = offsets[i : j + 1] - offsets[i]
                _, _, _, h, bound = _tokenise(data[offsets[i] : offsets[j]], part)
                row_end = np.repeat(bound[1:], np.diff(bound))
                for w, keys in known.items():
                    at, k = _lookup(run_hashes(h, w), keys, bits[w])
                    total[w] += np.bincount(k[at + w <= row_end[at]], minlength=len(keys))
        for w, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w, np.int32)), pa.array(at.astype(np.int64)), pa.array(n[at])], names=["w", "k", "n"])

    counts = {w: np.zeros(len(k), np.int64) for w, k in block.shingles.items()}
    for r in docs.select(F.col(text_col)).mapInArrow(tidy(scan), "w int, k long, n long").groupBy("w", "k").agg(F.sum("n").alias("n")).collect():
        counts[r["w"]][r["k"]] = r["n"]
    held.destroy()
    return counts


def find_windows(block: Block, bits: dict[int, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Verified occurrences (first word, window) in a run of rows, the rows' first words, and each word's row."""
    data, s, e, h, bound = _tokenise(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bound))
    starts, windows = [], []
    for w, (keys, lo, hi, entry) in block.prefix.items():
        at, k = _lookup(run_hashes(h, w), keys, bits[w])
        reps = hi[k] - lo[k]
        p = np.repeat(at, reps)
        which = np.repeat(lo[k], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        win, off = entry[which, 0], entry[which, 1]
        a = p - off
        fits = (a >= bound[row[p]]) & (a + block.sizes[win] <= bound[row[p] + 1])
        starts.append(a[fits])
        windows.append(win[fits])
    a = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    win = np.concatenate(windows) if windows else np.zeros(0, np.int64)
    sizes = block.sizes[win]
    good = np.ones(len(a), bool)
    for k in range(int(sizes.max(initial=0))):  # hashes first, then bytes
        on = good & (k < sizes)
        good[on] = h[a[on] + k] == block.seq_hash[block.starts[win[on]] + k]
    a, win = a[good], win[good]
    raw = data.tobytes() if len(a) else b""
    same = np.ones(len(a), bool)
    for x, (first, w) in enumerate(zip(a.tolist(), win.tolist(), strict=True)):
        of = block.starts[w]
        same[x] = all(raw[s[first + k] : e[first + k]] == block.words[block.seq[of + k]] for k in range(block.sizes[w]))
    return a[same], win[same], bound, row



def _scanner(held: Broadcast, name: str, text_col: str) -> Callable:
    """Rows of `texts` to the first column, n_words, the places of hit words, and the items with occurring windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        bits = {w: _filter(p[0]) for w, p in block.prefix.items()}
        for batch in batches:
            data, offsets = text_bytes(text_of(batch, text_col))
            for i, j in steps(offsets):
                a, win, bound, row = find_windows(block, bits, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cover = np.zeros(len(row) + 1, np.int32)
                np.add.at(cover, a, 1)
                np.add.at(cover, a + block.sizes[win], -1)
                hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                items: dict[int, set[str]] = {}
                for r, w in set(zip(row[a].tolist(), win.tolist(), strict=True)):
                    items.setdefault(r, set()).update(block.owners[w])
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, bound), pa.int32()), pa.array((hit - bound[row[hit]]).astype(np.int32)))
                found = pa.array([sorted(items.get(r, ())) for r in range(j - i)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(bound), pa.int64()), hits, found], names=[name, "n_words", "hits", "items"])

    return scan


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of about block_bytes, each small enough for the driver and a broadcast; the last has nothing left out."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("length(text) > 0").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r[0], r[1]) for r in part.collect()]


def indexed(docs: DataFrame, benchmark: DataFrame, size: int, shingle: int, block_bytes: int, text_col: str) -> Iterator[Block]:
    for items in blocks(benchmark, block_bytes):
        block = build_block(items, size, shingle)
        if block.shingles:
            choose_prefixes(block, count_shingles(docs, text_col, block), shingle)
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, carry: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id (or `carry` as row), n_words, n_hit, n_items, items_sha256, contaminated, items (sorted item_ids)."""
    sc = docs.sparkSession.sparkContext
    state, name = texts(docs, id_col, text_col, carry)
    rest = "n_words long, hits array<int>, items array<string>"
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    todo = indexed(docs, benchmark, size, shingle, block_bytes, text_col)
    block, following = next(todo), next(todo, None)
    if following is None:
        return _judged(state.mapInArrow(tidy(_scanner(sc.broadcast(block), name, text_col)), schema_of(name, state.schema[name].dataType, rest)), name)
    slim = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    schema, found = schema_of("doc_id", slim.schema["doc_id"].dataType, rest), None
    while block is not None:
        held = sc.broadcast(block)
        hits = slim.mapInArrow(tidy(_scanner(held, "doc_id", text_col)), schema).where("size(hits) > 0").groupBy("doc_id").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))
        hits = materialize(hits)
        held.destroy()
        found = hits if found is None else found.unionByName(hits)
        block, following = following, next(todo, None)
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy("doc_id").agg(every("hits"), every("items")).withColumnRenamed("doc_id", "key")
    words = texts(docs, id_col, text_col, carry, key.alias("key"))[0]
    counted = words.mapInArrow(tidy(_counter(name, text_col)), schema_of(name, state.schema[name].dataType, "n_words long, key struct<a:long,b:long>"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return _judged(counted.join(found, "key", "left").select(name, "n_words", empty("hits", "int"), empty("items", "string")), name)


def _counter(name: str, text_col: str) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(text_of(batch, text_col))
            n = [np.zeros(0, np.int64)]
            for i, j in steps(offsets):
                n.append(np.diff(_tokenise(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[4]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n), pa.int64()), batch.column(batch.num_columns - 1)], names=[name, "n_words", "key"])

    return scan


def _judged(found: DataFrame, name: str) -> DataFrame:
    hit = F.size("hits").cast("long")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(name, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), "items")
