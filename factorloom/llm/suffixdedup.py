"""Suffix-array dedup: every byte covered by a string of `span` bytes that also starts anywhere else is removed.

1. Every document names its anchors (see anchors.py): runs of windows of span bytes that share their smallest gram.
   Equal windows have equal grams at equal offsets, so they meet under one gram hash. Only hashes that occur twice
   go on. An anchor whose context has one form under its hash is repeated as a whole.
2. Other contexts are reduced to one copy of each form with its number of copies, their bytes are fetched once, and
   they are dealt into shards by gram hash. Each shard is sorted by external induced sorting (xsort.py), whose queues and
   arrays hold SORT_MEMORY in memory, a part of a shard, and the rest on disk; a window is repeated if its form has two
   copies or if a neighbour in the suffix array shares span bytes.
3. No task may hold a group without a bound, so a hash with more than HOT_BYTES of different forms is split: its windows are
   dealt out one by one, by 128 bits of their content, and counted with partial aggregation.
4. Repeated windows return to their documents as spans.

With `words` the same runs a second time over words (runs of non-blank bytes, by 64-bit hash), so that passages of that
many whole words go as well, however short in bytes and whatever blanks stand between; what either way finds is removed.

Strings are judged on the input; a first occurrence is removed like any other; matches never cross documents.

Equal contexts are told by 128 bits (gram hash and context hash), equal windows of a shard by their bytes.

Defined results: a null text is empty; texts shorter than span keep all; very long texts are read in pieces that overlap;
repeated rows repeat each other; ties can't arise; null ids take part; an empty table gives no rows; further columns, of
whatever name, are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import xsort
from .anchors import anchors
from .common import drop, materialize, schema_of, text_bytes, texts, tidy, whole_row
from .words import _BASE, _INVERSE, _TABLE, mix, powers, word_bounds, word_hashes

SPAN, GRAM = 400, 100
#: Words of a passage, and of the gram that brings equal passages together.
WORDS, WORD_GRAM = 51, 13
_NONBLANK = np.ones(256, bool)
_NONBLANK[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of contexts in a shard, about; and under one hash, before its windows are dealt out one by one.
SHARD_BYTES, HOT_BYTES = 4 << 20, 4 << 20
#: Bytes that the queues and each array of a sort may hold in memory; a shard is several times that, so they go to disk.
SORT_MEMORY = 2 << 20
_KEY = "k long, size int"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs as a struct, their text, and k and size, which equal rows share and others don't."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return texts(docs, id_col, text_col, whole_row(docs), F.xxhash64(F.col(id_col).cast("string"), text, F.lit(1)).alias("k"), F.octet_length(text).alias("size"))[0]


def units(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, or the hashes of the words, of a text column and the offsets of its rows."""
    data, offsets = text_bytes(column)
    if not words:
        return data, offsets
    starts, ends = word_bounds(data, offsets, _NONBLANK)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def find_anchors(docs: DataFrame, text_col: str, span: int, gram: int, words: bool = False) -> DataFrame:
    """(h, c, k, size, p, n): gram hash, context hash, document, first window and number of windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = units(batch.column(2), words)
            k, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, p, n, h, c in anchors(data, offsets, gram, span):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(k[row]), pa.array(size[row]), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "c", "k", "size", "p", "n"])

    return docs.where(F.col("size") >= span).select("k", "size", f"row.`{text_col}`").mapInArrow(tidy(scan), f"h long, c long, {_KEY}, p int, n int")


def runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True."""
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _fetch(forms: list[DataFrame], docs: DataFrame, text_col: str, spans: list[int]) -> DataFrame:
    """(kind, h, c, times, n, bytes) of each form, read from the document that stands for it. forms: of bytes, and perhaps of words."""
    both = [f.select("k", "size", F.struct(F.lit(kind).alias("kind"), "h", "c", "times", "p", "n").alias("x")) for kind, f in enumerate(forms)]
    need = (both[0].unionByName(both[1]) if len(both) > 1 else both[0]).groupBy("k", "size").agg(F.collect_list("x").alias("need"))
    joined = docs.select("k", "size", F.col(f"row.`{text_col}`").alias("text")).join(need, ["k", "size"]).select("k", "text", "need")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None  # equal documents follow each other
        for batch in batches:
            raw = []
            for words in range(len(spans)):
                data, offsets = units(batch.column(1), bool(words))
                raw.append((data.tobytes(), offsets, data.itemsize))
            out: list[tuple] = []
            for r, k in enumerate(batch.column(0).to_pylist()):
                if k == seen:
                    continue
                seen = k
                for x in batch.column(2)[r].as_py():
                    text, offsets, size = raw[x["kind"]]
                    a = int(offsets[r]) + x["p"]
                    out.append((x["kind"], x["h"], x["c"], x["times"], x["n"], text[a * size : (a + x["n"] + spans[x["kind"]] - 1) * size]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["kind", "h", "c", "times", "n", "bytes"])

    return joined.mapInArrow(tidy(cut), "kind int, h long, c long, times long, n int, bytes binary")


def window_hashes(data: np.ndarray, span: int, salt: int = 0) -> np.ndarray:
    """A hash of each window of span units."""
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data + np.uint64(salt)) * powers(int(_BASE), len(data)), out=run[1:])
    return mix((run[span:] - run[:-span]) * powers(int(_INVERSE), len(data) + 1)[: len(data) - span + 1])


def _really(hit: np.ndarray, data: np.ndarray, offsets: np.ndarray, base: np.ndarray, n: np.ndarray, span: int) -> np.ndarray:
    """Of the windows that are hit, those whose words are repeated among them."""
    at = np.flatnonzero(hit)
    of = np.searchsorted(base, at, side="right") - 1
    on = at - base[of] < n[of]
    at, of = at[on], of[on]
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data) * powers(int(_BASE), len(data)), out=run[1:])
    first = at - base[of] + offsets[of]
    _, which, times = np.unique(mix((run[first + span] - run[first]) * powers(int(_INVERSE), len(data) + 1)[first]), return_inverse=True, return_counts=True)
    out = np.zeros(len(hit), bool)
    out[at[times[which] > 1]] = True
    return out


def sort_shard(span: int, memory: int, words: bool = False) -> Callable[[pa.Table], pa.Table]:
    """The repeated windows of one shard of forms, as flat (first, after the last) pairs for each form."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        h, c, n, times = (t.column(x).to_numpy() for x in ("h", "c", "n", "times"))
        order = np.lexsort((c, h))
        one = order[np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))]
        data, offsets = text_bytes(t.column("bytes").take(pa.array(one)))
        h, c, n, times = h[one], c[one], n[one], times[one]
        exact = data.view(np.uint64) if words else None
        if words:  # a byte of a word's hash; what is equal by such bytes is compared by the whole hashes below
            data, offsets = (exact >> np.uint64(56)).astype(np.int16) % 250, offsets // 8
        else:
            there = np.bincount(data, minlength=256) > 0
            data = (np.cumsum(there) - 1).astype(np.int16)[data]  # bytes that occur, in their order, so that one byte holds a symbol
        base = offsets[:-1] + np.arange(len(one))
        top = int(data.max(initial=0)) + 2
        kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32
        text = np.ones(int(offsets[-1]) + len(one), kind)  # 1 ends a context, bytes or words follow from 2
        for k, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text[a + k : z + k] = data[a:z] + 2
        del data, t
        hit = xsort.repeated(text, span, memory)
        if words:
            hit = _really(hit, exact, offsets, base, n, span)
        spans = []
        for b, m, k in zip(base.tolist(), n.tolist(), times.tolist(), strict=True):
            if k > 1:
                spans.append([0, m])
            else:
                a, z = runs(hit[b : b + m])
                spans.append(np.stack([a, z], axis=1).ravel().tolist())
        return pa.table({"h": h, "c": c, "spans": pa.array(spans, pa.list_(pa.int32()))})

    return tidy(run)


def _windows(hot: DataFrame, span: int, words: bool = False) -> DataFrame:
    """(w, x, h, c, i): two hashes of every window of hot forms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, n = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for r, b in enumerate(batch.column(3)):
                data = np.frombuffer(b.as_py(), np.uint64) if words else _TABLE[np.frombuffer(b.as_py(), np.uint8)]
                both = [window_hashes(data, span, salt)[: n[r]].view(np.int64) for salt in (0, 0x5851F42D4C957F2D)]
                m = len(both[0])
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(np.full(m, h[r])), pa.array(np.full(m, c[r])), pa.array(np.arange(m, dtype=np.int32))], names=["w", "x", "h", "c", "i"])

    return hot.select("h", "c", "n", "bytes").mapInArrow(tidy(scan), "w long, x long, h long, c long, i int")


def _repeated_anchors(docs: DataFrame, text_col: str, span: int, gram: int, words: bool) -> tuple[DataFrame, DataFrame]:
    """Anchors (find_anchors) whose gram occurs again, with `mixed` if it has several contexts; and one row (h, c, times, k, size, p, n) for each of these contexts."""
    once = materialize(find_anchors(docs, text_col, span, gram, words))
    again = once.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), (F.min("c") != F.max("c")).alias("mixed")).where("_n > 1").drop("_n")
    again = materialize(again)  # a join of two plain scans can be split where a hash is common
    every = materialize(once.join(again, "h"))
    drop(once)
    forms = every.where("mixed").groupBy("h", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "size", "p", "n")).alias("one"))
    return every, materialize(forms.select("h", "c", "times", "one.*"))


def _spans(every: DataFrame, forms: DataFrame, bytes_: DataFrame, span: int, shard_bytes: int, hot_bytes: int, words: bool) -> DataFrame:
    """(k, size, spans): ranges of bytes (or words) to remove, flat and in no order, for documents that have any. bytes_: the contexts of forms."""
    room = (F.col("n") + span - 1).cast("long") * (8 if words else 1)
    hot = materialize(forms.groupBy("h").agg(F.sum(room).alias("b")).where(F.col("b") > hot_bytes).select("h"))
    any_hot = bool(hot.limit(1).count())
    shards = int((forms.agg(F.sum(room)).first()[0] or 0) // shard_bytes) + 1
    out = "h long, c long, spans array<int>"
    cool = bytes_.join(hot, "h", "left_anti") if any_hot else bytes_
    found = cool.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInArrow(sort_shard(span, SORT_MEMORY, words), out)
    if any_hot:
        every_window = materialize(_windows(bytes_.join(hot, "h", "left_semi").dropDuplicates(["h", "c"]), span, words))
        twice = every_window.groupBy("w", "x").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        starts = every_window.join(twice, ["w", "x"]).select("h", "c", F.array("i", F.col("i") + 1).alias("spans"))
        whole = forms.join(hot, "h", "left_semi").where("times > 1").select("h", "c", F.array(F.lit(0), F.col("n")).alias("spans"))
        found = found.unionByName(starts.unionByName(whole).groupBy("h", "c").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    found = materialize(found.where(F.size("spans") > 0))
    of_mixed = every.where("mixed").join(found, ["h", "c"]).select("k", "size", "p", "spans")
    of_whole = every.where("not mixed").select("k", "size", "p", F.array(F.lit(0), F.col("n")).alias("spans"))
    rows = of_mixed.unionByName(of_whole).select("k", "size", F.transform("spans", lambda x, i: x + F.col("p") + F.when(i % 2 == 1, span - 1).otherwise(0)).alias("spans"))
    return rows.groupBy("k", "size").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def find_repeats(docs: DataFrame, text_col: str, searches: list[tuple[int, int]], shard_bytes: int, hot_bytes: int) -> list[DataFrame]:
    """_spans of keyed docs for each search (span, gram): the first is over bytes, a second one over words. Texts are fetched once for both."""
    found = [_repeated_anchors(docs, text_col, span, gram, bool(words)) for words, (span, gram) in enumerate(searches)]
    bytes_ = materialize(_fetch([forms for _, forms in found], docs, text_col, [span for span, _ in searches]))
    return [_spans(every, forms, bytes_.where(F.col("kind") == words).drop("kind"), span, shard_bytes, hot_bytes, bool(words)) for words, ((every, forms), (span, _)) in enumerate(zip(found, searches, strict=True))]


def dedup(docs: DataFrame, finish: Callable, out: StructType, span: int = SPAN, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES, id_col: str = "doc_id", text_col: str = "text", words: tuple[int, int] | None = None) -> DataFrame:
    """Every row of docs through finish(array of row structs, merged (first, after the last) arrays of each row, the same of passages of words), which gives rows of `out`. words: span and gram in words, to find such passages too."""
    docs = keyed(docs, id_col, text_col)
    spans, *more = find_repeats(docs, text_col, [(span, gram), *([words] if words else [])], shard_bytes, hot_bytes)
    none = F.lit(None).cast("array<int>")
    spans = spans.withColumn("of_words", none)
    for x in more:
        spans = spans.unionByName(x.select("k", "size", none.alias("spans"), F.col("spans").alias("of_words"))).groupBy("k", "size").agg(F.first("spans", True).alias("spans"), F.first("of_words", True).alias("of_words"))
    joined = docs.join(spans, ["k", "size"], "left").select("row", "spans", "of_words")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = lambda x: np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) if x.is_valid else np.zeros(0, np.int64)
            passages = [np.zeros((0, 2), np.int64)] * batch.num_rows
            if words:
                texts_ = batch.column(0).field(text_col)
                for r, x in enumerate(batch.column(2)):
                    if x.is_valid:
                        data, offsets = text_bytes(texts_.slice(r, 1))
                        starts, ends = word_bounds(data, offsets, _NONBLANK)
                        w = flat(x).reshape(-1, 2)
                        passages[r] = merge(np.stack([starts[w[:, 0]], ends[w[:, 1] - 1]], axis=1))
            yield finish(batch.column(0), [merge(flat(x)) for x in batch.column(1)], passages)

    return joined.mapInArrow(tidy(scan), out)


def merge(flat: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges as one, in order."""
    r = flat.reshape(-1, 2)
    if not len(r):
        return r
    r = r[np.argsort(r[:, 0], kind="stable")]
    end = np.maximum.accumulate(r[:, 1])
    new = np.append(True, r[1:, 0] > end[:-1])
    first = np.flatnonzero(new)
    return np.stack([r[first, 0], end[np.append(first[1:], len(r)) - 1]], axis=1)


def digests(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (flat), and n_passage_bytes: how many bytes lie in repeated passages of so many words, if these are asked for."""

    def finish(rows: pa.StructArray, spans: list[np.ndarray], passages: list[np.ndarray]) -> pa.RecordBatch:
        data, offsets = text_bytes(rows.field("text"))
        raw = data.tobytes()
        kept = []
        for r, s in enumerate(spans):
            a, digest = int(offsets[r]), hashlib.sha256()
            at = a
            for x, z in s.tolist():
                digest.update(raw[at : a + x])
                at = a + z
            digest.update(raw[at : int(offsets[r + 1])])
            kept.append(digest.hexdigest())
        removed, covered = ([int((s[:, 1] - s[:, 0]).sum()) for s in x] for x in (spans, passages))
        return pa.RecordBatch.from_arrays([rows.field("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.string()), pa.array([s.ravel().tolist() for s in spans], pa.list_(pa.int64())), pa.array(covered, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage_bytes"])

    out = schema_of("doc_id", docs.schema["doc_id"].dataType, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, n_passage_bytes long")
    return dedup(docs.select("doc_id", "text"), finish, out, **options)


def remove(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated bytes cut out of the text; a cut inside a character keeps that character out as well."""

    def finish(rows: pa.StructArray, spans: list[np.ndarray], passages: list[np.ndarray]) -> pa.RecordBatch:
        out = []
        for text, s, p in zip(rows.field(text_col), spans, passages, strict=True):
            s = merge(np.concatenate([s, p])) if len(p) else s
            if not len(s):
                out.append(text.as_py())
                continue
            raw, parts, at = text.as_py().encode(), [], 0
            for x, z in s.tolist():
                parts.append(raw[at:x].decode("utf-8", "ignore"))
                at = z
            parts.append(raw[at:].decode("utf-8", "ignore"))
            out.append("".join(parts))
        cols = [pa.array(out, f.type) if f.name == text_col else rows.field(k) for k, f in enumerate(rows.type)]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in rows.type])

    return dedup(docs, finish, docs.schema, text_col=text_col, **options)
