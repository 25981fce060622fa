"""Shards that are too large are split by shared bits; no link is lost, and copies of a point stay bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import simhash
from factorloom.llm.components import components


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("shard_points", [20, 150, 10**6])
def test_no_link_is_lost(spark, radius, shard_points):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    near = base.repeat(4) ^ (np.uint64(1) << rng.integers(0, 64, 480).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 480).astype(np.uint64))
    points = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    label = {r.node: r.label for r in components(simhash.links(df, radius, shard_points)).collect()}
    parent = list(range(len(points)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= radius):
            parent[root(i)] = root(int(j))
    signed = points.view(np.int64).tolist()
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(root(i), []).append(x)
    for g in groups.values():
        assert {label.get(x, x) for x in g} == {min(g)}


def test_copies_are_bounded(spark, monkeypatch):
    """Four times the points, with shards as large, are dealt to four times the rows or less."""
    rng, rows = np.random.default_rng(1), []
    plain = simhash.materialize

    def count(df):
        out = plain(df)
        if out.columns == ["leaf", "fp", "own"]:
            rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", count)
    monkeypatch.setattr(simhash, "TOP_LEAVES", 8)
    for n in (4000, 16_000):
        df = spark.createDataFrame([(int(x),) for x in np.unique(rng.integers(-(2**62), 2**62, n))], "fp long")
        assert simhash.links(df, 2, 500).agg(F.count(F.lit(1))).first()[0] == 0
    assert rows[1] < 4.4 * rows[0] and rows[1] < 8 * 16_000
