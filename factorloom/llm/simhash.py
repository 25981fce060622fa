"""SimHash near-duplicates: exact Hamming links by sharded vantage-point trees, then components.

Fingerprints: words are runs of non-blank bytes after lower-casing A-Z, shingles are runs of words joined by
one space (repeats count), each hashed by XXH64; a bit is 1 if it is set in over half of the hashes.

Links: equal fingerprints are one point (aggregated before anything else, so a group of copies of any size is
one row). A top tree of at most TOP_LEAVES leaves, fitted on a bounded sample, deals points into shards by distance; a
point also visits the shards beyond its own that its ball of radius r overlaps, so that each pair meets in the
shard of one of them. Each level of such a tree copies about a third of random points, so it isn't made deeper; a shard of
more than shard_points is split instead by shared bits: cut into r+1 runs of bits, two fingerprints within r differ in at
most r of them and agree in one, by which they meet. So a point has a bounded number of copies however many there are.
What one task gets builds its own tree and hands on one link from each joined point to its local representative, not all
pairs. Components of these links are the components of all pairs.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a null id takes
part, but cannot be a component_id unless its whole component is null; repeated rows stay; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vptree
from .common import materialize, schema_of, text_of, texts, tidy, whole_row
from .components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Points that one shard should hold, and points the top tree is fitted on at most.
SHARD_POINTS, SAMPLE_POINTS, TOP_LEAVES = 1_000_000, 65_536, 64
_HASH_STEP = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text; memory is bounded by the words, hashes go in steps."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, one = b" ".join(words), xxhash.xxh64_digest
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - shingle + 1], ends[shingle - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), _HASH_STEP):
        ones += _ones(b"".join([one(joined[a:b], SEED) for a, b in zip(starts[k : k + _HASH_STEP].tolist(), ends[k : k + _HASH_STEP].tolist(), strict=True)]))
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _ones(raw: bytes) -> np.ndarray:
    """In how many of the 8-byte big-endian hashes each bit is set."""
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def bits(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes that are there already; zero if there is none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _HASH_STEP):
        ones += _ones(hashes[k : k + _HASH_STEP].astype(">u8").tobytes())
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (or `carry` as row) and fp: the fingerprint as a signed long."""
    slim, name = texts(docs, id_col, text_col, carry)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in text_of(batch, text_col)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[name, "fp"])

    return slim.mapInArrow(tidy(scan), schema_of(name, slim.schema[name].dataType, "fp long"))


def local_links(points: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (each joined fingerprint, its representative) of one shard: its points, and guests from other shards."""
    every = np.unique(np.concatenate([points, guests]))
    parent = np.arange(len(every))

    def root(x: np.ndarray) -> np.ndarray:
        while (parent[x] != x).any():
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = root(a), root(b)
            on = a != b
            a, b = a[on], b[on]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))

    points = np.unique(points)
    at = np.searchsorted(every, points)
    for q, p in vptree.pairs(points, every, radius):
        union(q, at[p])
    top = root(np.arange(len(every)))
    on = np.flatnonzero(top != np.arange(len(every)))
    return every[on], every[top[on]]


def links(fps: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(u, v) links over distinct fingerprints `fp` that have the components of all pairs within radius."""
    spark = fps.sparkSession
    n = fps.count()
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), n // 1024)  # enough shards for the cluster
    leaves = int(min(TOP_LEAVES, max(1, spread, -(-n // shard_points))))
    share = min(1.0, SAMPLE_POINTS / max(n, 1))
    cut = int(share * (1 << 32))
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 32)) < cut).limit(2 * SAMPLE_POINTS).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    top = vptree.build(np.unique(sample), bucket=1, max_leaves=leaves)

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            q = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            home = np.zeros(len(q), np.int64)
            for leaf, idx in vptree.reach(top, q, 0):
                home[idx] = leaf
            for leaf, idx in vptree.reach(top, q, radius):
                idx = idx[home[idx] <= leaf]  # a pair meets in the later home of the two
                if len(idx):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), leaf, np.int32)), pa.array(q[idx].view(np.int64)), pa.array(home[idx] == leaf)], names=["leaf", "fp", "own"])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, own = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["own"].to_numpy(bool)
        u, v = local_links(fp[own], fp[~own], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = materialize(fps.select("fp").mapInArrow(deal, "leaf int, fp long, own boolean"))
    large = [(r["leaf"], -(-r["n"] // shard_points)) for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_points).collect()]
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("int") for pair in large for x in pair]), F.col("leaf")), F.lit(0)) if large else F.lit(0)
    split = [F.struct(F.lit(k).alias("run"), F.pmod(F.xxhash64(bits_), parts.cast("long")).alias("part")) for k, bits_ in enumerate(_runs(radius + 1))]
    whole = F.array(F.struct(F.lit(0).alias("run"), F.lit(0).cast("long").alias("part")))
    spread_out = dealt.select("leaf", "fp", "own", F.explode(F.when(parts > 0, F.array(*split)).otherwise(whole)).alias("at")) if large else dealt.select("leaf", "fp", "own", F.explode(whole).alias("at"))
    return spread_out.select("leaf", "at.run", "at.part", "fp", "own").groupBy("leaf", "run", "part").applyInPandas(match, "u long, v long")


def _runs(n: int) -> list[Column]:
    """The 64 bits of fp as n runs."""
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (z - a)) - 1 if z - a < 63 else -1).cast("long")) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def labelled(points: DataFrame, label: DataFrame) -> DataFrame:
    """points (one row for each distinct fp) with `label`, equal within a component; label: (node, label) of linked points."""
    return materialize(points.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard_points: int = SHARD_POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    each = materialize(fingerprints(docs, shingle, None, id_col, text_col))
    points = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    points = labelled(points, components(links(points, radius, shard_points)))
    least = points.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = points.join(least, "label").select("fp", "component_id")
    return each.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard_points: int = SHARD_POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: the one with the smallest id (a null one last), then the smallest fingerprint and text."""
    each = materialize(fingerprints(docs, shingle, whole_row(docs), id_col, text_col))
    return choose(each, components(links(each.select("fp").distinct(), radius, shard_points)), id_col, text_col)


def choose(each: DataFrame, label: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of representatives, from all rows (row, fp) and the (node, label) of linked fps."""
    order = F.struct(F.col("id").isNull(), "id", "fp")
    points = labelled(materialize(each.select("fp", F.col(f"row.`{id_col}`").alias("id")).groupBy("fp").agg(F.min(order).alias("least"))), label)
    chosen = points.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.fp").alias("fp"), F.col("least.id").alias("id"))
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("none")).alias("key")
    keyed = each.withColumn("id", F.col(f"row.`{id_col}`")).select("row", "fp", key)
    kept = keyed.join(chosen.select("fp", key), ["fp", "key"], "left_semi")  # rows of one id and fingerprint meet here, so they need no further shuffle
    return kept.groupBy("fp", "key").agg(F.min_by("row", F.struct(F.col(f"row.`{text_col}`").isNull(), f"row.`{text_col}`")).alias("row")).select("row.*")
