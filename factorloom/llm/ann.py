"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own k-means codebook; a vector's cell is its pair of
centroids. A query walks cells in the order of the summed distance of both centroids (multi-sequence algorithm: a
heap over the two sorted lists) until the cells met hold a share of all rows, and every vector of these cells is
scored exactly on the original values.

Codebooks and the share are fitted on a sample of at most SAMPLE vectors: the share is the one within which
RECALL of the true neighbours in the sample lie. Every row is indexed. Of equal vectors only the K+1 smallest ids
can be answers to a K-nearest search, so a group of copies shrinks to K+1 rows before anything is matched. Cells
are packed into shards of about SHARD_ROWS rows, larger cells are split. A query is sent to the shards of its cells; a shard
that more than SHARD_ASKS queries ask is held by several tasks, which share them. So rows moved are those of the index, the
questions, and one row of the index for every SHARD_ASKS / SHARD_ROWS questions at most. A task holds one shard and
streams its questions. What is broadcast is bounded by the number of cells.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates;
vectors of different lengths have no cosine, so each length is searched among itself; equal (vec_id, vector) rows are one,
rows of one vec_id with different vectors are several; very large and small components are scaled by powers of two, which
changes no score; ties go to the smaller vec_id; fewer candidates than k give fewer rows; an empty table gives no rows;
further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy

SAMPLE, RECALL, ROUNDS = 10_000, 0.96, 10
SHARD_ROWS, SHARD_ASKS = 16_384, 131_072
#: Questions that a task works on at once.
ASKS_AT_ONCE = 1024
#: Mean rows a cell, and centroids a half at most.
CELL_ROWS, MAX_CENTROIDS = 200, 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, dim): distinct rows whose vectors take part; dim is the length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"])


def tame(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=1e-300))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = tame(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        of = nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[a : a + 65536], c).argmin(axis=1) for a in range(0, len(x), 65536)]) if len(x) else np.zeros(0, np.int64)


def walk(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by rising summed distance."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, done = [(a[0] + b[0], 0, 0)], set()
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(o1[i]), int(o2[j])
        done.add((i, j))
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


class Index:
    """Codebooks, the share of rows to visit, and (later) the rows of each cell."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, seed: int = 5) -> None:
        u = unit(sample)
        n = int(min(MAX_CENTROIDS, max(2, round((rows / CELL_ROWS) ** 0.5)), len(u)))
        self.half = max(1, u.shape[1] // 2)
        self.books = (kmeans(u[:, : self.half], n, seed), kmeans(u[:, self.half :], n, seed + 1) if u.shape[1] > self.half else np.zeros((1, 0)))
        self.counts = np.zeros(len(self.books[0]) * len(self.books[1]), np.int64)
        cell, some = self.cells(sample), np.random.Generator(np.random.PCG64(seed)).permutation(len(u))[:200]
        held = np.bincount(cell, minlength=len(self.counts))
        shares = []
        for q in some:
            s = u @ u[q]
            s[q] = -2
            best = np.argpartition(-s, min(k, len(s) - 1))[:k]
            met, at = 0, {}
            for c in self.order(sample[q]):
                met += held[c]
                at[c] = met
                if len(at) == len(self.counts) or all(int(cell[b]) in at for b in best):
                    break
            shares += [at.get(int(cell[b]), len(u)) / len(u) for b in best]
        self.share = float(np.quantile(shares, RECALL)) if shares else 1.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        u = unit(x)
        return nearest(u[:, : self.half], self.books[0]) * len(self.books[1]) + nearest(u[:, self.half :], self.books[1])

    def order(self, q: np.ndarray) -> Iterator[int]:
        u = unit(q[None, :])
        d1, d2 = distances(u[:, : self.half], self.books[0])[0], distances(u[:, self.half :], self.books[1])[0]
        for i, j in walk(d1, d2):
            yield i * len(self.books[1]) + j

    def visit(self, q: np.ndarray, least: int) -> list[int]:
        """Cells that hold at least the share of all rows, and `least` of them."""
        want, met, out = max(least, self.share * self.counts.sum()), 0, []
        for c in self.order(q):
            if self.counts[c]:
                out.append(c)
                met += self.counts[c]
                if met >= want:
                    break
        return out

    def pack(self) -> None:
        """Deal cells into shards: first shard and number of shards of each cell."""
        self.first, self.parts, shard, room = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64), 0, SHARD_ROWS
        for c, n in enumerate(self.counts.tolist()):
            if n > SHARD_ROWS:
                shard += room < SHARD_ROWS
                self.first[c], self.parts[c] = shard, -(-n // SHARD_ROWS)
                shard, room = shard + int(self.parts[c]), SHARD_ROWS
            else:
                if n > room:
                    shard, room = shard + 1, SHARD_ROWS
                self.first[c] = shard
                room -= n


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Shard:
    """The rows of a shard, gathered batch by batch, and the answers they give."""

    def __init__(self, key: tuple[int, int], k: int) -> None:
        self.key, self.k, self.parts, self.ready = key, k, [], False

    def add(self, ids: np.ndarray, cells: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((ids, cells, x))

    def answer(self, of: np.ndarray, mark: np.ndarray, q: np.ndarray, cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The k best of this shard for each question."""
        if not self.ready:
            self.ids, self.cell, x = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, q.shape[1])))
            self.x, self.parts, self.ready = tame(x), [], True
            self.norm = np.sqrt((self.x * self.x).sum(axis=1))
            self.places = pd.Series(self.cell).groupby(self.cell).indices
        q = tame(q)
        norm = np.sqrt((q * q).sum(axis=1))
        which, asked = np.repeat(np.arange(len(of)), [len(c) for c in cells]), np.concatenate([np.zeros(0, np.int64), *cells])
        by = pd.Series(which).groupby(asked).indices
        pairs = [np.zeros((0, 2), np.int64)]
        for cell, ask in by.items():
            at, some = self.places.get(cell), which[ask]
            if at is None:
                continue
            s = (q[some] @ self.x[at].T) / (norm[some][:, None] * self.norm[at][None, :])
            i, j = np.nonzero(of[some][:, None] == self.ids[at][None, :])
            own = (q[some[i]] == self.x[at[j]]).all(axis=1)  # the query's own row
            s[i[own], j[own]] = -2
            kth = np.partition(s, max(0, s.shape[1] - self.k), axis=1)[:, max(0, s.shape[1] - self.k)]
            i, j = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -2))
            pairs.append(np.stack([some[i], at[j]], axis=1))
        i, j = np.concatenate(pairs).T
        score = (q[i] * self.x[j]).sum(axis=1) / (norm[i] * self.norm[j])
        order = np.lexsort((self.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        on = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        i, j = i[on], j[on]
        yield pa.RecordBatch.from_arrays([pa.array(of[i]), pa.array(mark[i]), pa.array(self.ids[j]), pa.array(score[on])], names=["query_id", "mark", "vec_id", "score"])


def answers(k: int) -> Callable:
    """Over rows (shard, part, asks, vec_id, mark, v, cells) in this order: those of a shard, then its questions."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cut.tolist()] if len(key) else [], [*cut.tolist(), len(key)], strict=True):
                if shard is None or shard.key != (key[a, 0], key[a, 1]):
                    shard = Shard((key[a, 0], key[a, 1]), k)
                for c in range(a, z, ASKS_AT_ONCE):
                    some = b.slice(c, min(z - c, ASKS_AT_ONCE))
                    ids, mark, x = some.column(3).to_numpy(), some.column(4).to_numpy(), vectors_of(some.column(5))
                    cells = [np.asarray(v, np.int64) for v in some.column(6).to_pylist()]
                    if key[a, 2]:
                        yield from shard.answer(ids, mark, x, cells)
                    else:
                        shard.add(ids, np.concatenate(cells), x)

    return scan


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (cosine): the k nearest found of each row that is_query holds for (a condition on vec_id)."""
    every = materialize(usable(vectors, id_col, vec_col))
    sizes = [(r["dim"], r["n"]) for r in every.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, n in sizes:
        found = _search(every.where(F.col("dim") == dim).drop("dim"), n, is_query, k)
        out = found if len(sizes) == 1 else out.unionByName(found)
    return out


def _search(every: DataFrame, n: int, is_query: Column, k: int) -> DataFrame:
    """search among n vectors (vec_id, v) of one length."""
    sc = every.sparkSession.sparkContext
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = every.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n")
    cut = int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = every.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= cut).limit(2 * SAMPLE).toPandas()
    sample = sample.sort_values("vec_id") if len(sample) else every.limit(1000).toPandas()
    index = Index(np.stack(sample["v"].to_numpy()).astype(np.float64), n, k)
    kind = every.schema["v"].dataType.simpleString()
    books = sc.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = books.value.cells(vectors_of(b.column(1))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    indexed = materialize(kept.select("vec_id", "v").mapInArrow(assign, f"vec_id long, v {kind}, cell int"))
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        index.counts[r["cell"]] = r["n"]
    index.pack()
    full = sc.broadcast(index)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = full.value
        for b in batches:
            for r, v in enumerate(vectors_of(b.column(1))):
                to: dict[int, list[int]] = {}
                for c in ix.visit(v, k + 1):
                    for s in range(int(ix.first[c]), int(ix.first[c] + ix.parts[c])):
                        to.setdefault(s, []).append(c)
                m = len(to)
                one = [b.column(c).take(pa.array([r] * m, pa.int64())) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.int64()), *one, pa.array(list(to.values()), pa.list_(pa.int32()))], names=["shard", "vec_id", "v", "mark", "cells"])

    asks = materialize(every.where(is_query).select("vec_id", "v", F.xxhash64("v").alias("mark")).mapInArrow(route, f"shard long, vec_id long, v {kind}, mark long, cells array<int>"))
    tasks = {r["shard"]: -(-r["n"] // SHARD_ASKS) for r in asks.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = sc.broadcast(np.array([tasks.get(s, 0) for s in range(int((index.first + index.parts).max()))], np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, times = full.value, held.value
        for b in batches:
            cell = b.column(2).to_numpy()
            shard = ix.first[cell] + b.column(0).to_numpy() % ix.parts[cell]
            for part in range(int(times[shard].max(initial=0))):  # a shard that nobody asks stays where it is
                at = np.flatnonzero(times[shard] > part)
                rows = b.take(pa.array(at))
                one = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), rows.column(2))
                yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(np.full(len(at), part, np.int64)), rows.column(0), rows.column(1), one], names=["shard", "part", "vec_id", "v", "cells"])

    columns = ["shard", "part", "asks", "vec_id", "mark", "v", "cells"]
    rows = indexed.mapInArrow(place, f"shard long, part long, vec_id long, v {kind}, cells array<int>").withColumns({"asks": F.lit(0), "mark": F.lit(0).cast("long")})
    many = sorted((s, t) for s, t in tasks.items() if t > 1)
    spread = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in many for x in pair]), F.col("shard")), F.lit(1)) if many else F.lit(1)
    asks = asks.withColumns({"asks": F.lit(1), "part": F.pmod(F.xxhash64("vec_id", "mark"), spread.cast("long"))})
    dealt = rows.select(columns).unionByName(asks.select(columns)).repartition("shard", "part").sortWithinPartitions("shard", "part", "asks")
    found = dealt.mapInArrow(tidy(answers(k)), "query_id long, mark long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
