"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. N-1 in the order of (id, size, crc32 of the text); rows equal in all three are
interchangeable. A keyed permutation of 0 .. N-1 maps a number to its shuffled place p, and then
``shard = p mod S`` and ``slot = p div S``: shard sizes differ by at most one row, slots have no gaps, and
both are computable from the number alone. DataFrame functions only; the text itself is never shuffled.

Defined results: a null text has size 8 and a null crc; null ids come first; repeated rows get places of
their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 6
#: Modulus of the round function; its square fits a signed 64-bit integer.
PRIME = 2_147_483_647


def round_keys(seed: int) -> list[tuple[int, int]]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return [(int(a), int(b)) for a, b in rng.integers(1_000_003, PRIME - 1, (ROUNDS, 2))]


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 .. n-1: a balanced network over side*side >= n, walked until it lands below n."""

    n: int
    seed: int = 42

    @property
    def side(self) -> int:
        side = max(1, int(np.sqrt(self.n)))
        while side * side < self.n:
            side += 1
        return side

    def once(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.side, x % self.side
        for a, b in round_keys(self.seed):
            t = (right * a + b) % PRIME
            left, right = right, (left + t * t % PRIME) % self.side
        return left * self.side + right

    def walks(self) -> int:
        """Applications that any number below n needs: the longest walk over the 2*sqrt(n)+1 places outside at most."""
        outside, steps = np.arange(self.n, self.side**2, dtype=np.int64), 1
        x = np.setdiff1d(outside, self.once(outside))  # where a walk can enter; cycles wholly outside are never met
        while len(x):
            x = self.once(x)
            x, steps = x[x >= self.n], steps + 1
        return steps

    def column(self, x: Column) -> Column:
        """The same as a Spark expression: a fold over rounds, which leaves a number alone once it is below n."""
        side, n = F.lit(self.side).cast("long"), F.lit(self.n).cast("long")
        keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in round_keys(self.seed)])

        def turn(lr: Column, key: Column) -> Column:
            t = (lr["r"] * key["a"] + key["b"]) % F.lit(PRIME).cast("long")
            return F.struct(lr["r"].alias("l"), ((lr["l"] + (t * t) % F.lit(PRIME).cast("long")) % side).alias("r"))

        def apply(v: Column) -> Column:
            start = F.struct(_div(v, side).alias("l"), (v % side).alias("r"))
            return F.aggregate(keys, start, turn, lambda lr: lr["l"] * side + lr["r"])

        first = apply(x)
        if self.walks() == 1:
            return first
        more = F.sequence(F.lit(2), F.lit(self.walks()))
        return F.aggregate(more, first, lambda v, _: F.when(v < n, v).otherwise(apply(v)))


def _div(a: Column, b: Column) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, b)


def numbered(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """df with global row numbers `row` 0 .. N-1 in the order of `keys`, and N.

    One range shuffle of df, which should be slim. The order is broken by a physical row number last, so
    that a group of equal rows, however large, spreads over partitions. The driver learns one count a partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    order = [*keys, "_tie"]
    placed = materialize_sorted(tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie"))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, before = 0, []
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("_part") + 1)
    return placed.withColumn("row", offset + F.col("_at")).drop("_part", "_at"), total


def materialize_sorted(df: DataFrame) -> DataFrame:
    """df written once, each row with its partition and its place there."""
    mono = F.monotonically_increasing_id()
    at = df.withColumn("_mono", mono)
    return materialize(at.withColumn("_part", F.shiftright("_mono", 33).cast("int")).withColumn("_at", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mono"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law), row."""
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows, total = numbered(slim, ["doc_id", "size", "text_crc32"])
    place = Feistel(max(total, 1), seed).column(F.col("row"))
    return rows.withColumn("_p", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        _div(F.col("_p"), F.lit(shards).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )
