"""The pipeline's near-duplicate stage joins all texts that share 0.8 or more of their five-word shingles."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def kept(rows, size=5):
    """Brute force: ids that stay of (id, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def test_copies(spark, documents):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for k in range(60):  # copies with some words changed, of copies too; and texts that share less
        d, t = rows[rng.randrange(len(rows))]
        w = (t or "").split()
        for _ in range(int(len(w) * rng.choice([0.01, 0.02, 0.04, 0.1]))):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = kept(rows)
    assert sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len(rows) - 20 and any(d >= 10_000 for d in want)
