"""Nearest neighbours: odd vectors, names and sizes against brute force, and shards that several tasks hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import ann


def nearest(rows, k=5):
    """Brute force over (vec_id, vector) rows: (query, rank, vec_id, score) of queries divisible by 50."""
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows))
    out = []
    for q, v in rows:
        if q % 50:
            continue
        a = np.array(v) / np.abs(v).max()
        scored = []
        for i, w in rows:
            if (i, w) != (q, v) and len(w) == len(v):
                b = np.array(w) / np.abs(w).max()
                scored.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(df, **options):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in ann.search(df, F.col("vec_id") % 50 == 0, **options).collect())


def same(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)
    assert [g[2] for g in got] == [w[2] for w in want]


@pytest.fixture
def all_cells(monkeypatch):
    """Every cell is visited, so that answers are exact."""
    build = ann.Index.__init__

    def init(self, *args, **options):
        build(self, *args, **options)
        self.share = 1.0

    monkeypatch.setattr(ann.Index, "__init__", init)


def test_odd_vectors_and_names(spark, all_cells):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4)) for i in range(120)] + [(50, rng.normal(size=4)), (200, rng.normal(size=3)), (201, rng.normal(size=3))]
    rows += [(300, 1e200 * rng.normal(size=4)), (301, 1e-200 * rng.normal(size=4)), (7, rows[7][1])]
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, 2, "c", 3) for i, v in rows] + [(400, [0.0] * 4, 1, 2, "c", 3), (450, None, 1, 2, "c", 3)], "vec_id long, embedding array<double>, shard int, cell int, v string, mark int")
    same(found(df), nearest(rows))


@pytest.mark.parametrize("asks", [3, 10**6])
def test_shards_held_by_several_tasks(spark, all_cells, monkeypatch, asks):
    """However many questions a shard gets, and however small shards are, answers are the same."""
    monkeypatch.setattr(ann, "SHARD_ASKS", asks)
    monkeypatch.setattr(ann, "SHARD_ROWS", 40)
    monkeypatch.setattr(ann, "ASKS_AT_ONCE", 7)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(3)) for i in range(0, 4000, 10)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    same(found(df), nearest(rows))
