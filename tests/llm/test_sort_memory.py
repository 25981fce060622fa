"""Memory of the arrays beside the queues of a sort, which decides whether two workers fit beside an executor's heap."""

import tracemalloc

import numpy as np
import pytest

from factorloom.llm import anchors, suffixdedup, xsort


@pytest.fixture(scope="module")
def text():
    """As many bytes as a shard, of which 100,000 stand twice."""
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(2, 28, int(rng.integers(2, 9))).astype(np.uint8)) for _ in range(3000)]
    out = np.frombuffer(b"\x1d".join(words[i] for i in rng.integers(0, 3000, 750_000)), np.uint8)[: suffixdedup.SHARD_BYTES]
    return np.concatenate([out[:-100_000], out[:100_000]])


def peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_sort_is_small(text):
    hit, most = peak(lambda: xsort.repeated(text, 400, suffixdedup.SORT_MEMORY))
    assert hit.sum() == 2 * (100_000 - 399)
    assert most < 28 * len(text)  # 35 times before


def test_anchors_are_small(text):
    rows = np.arange(0, len(text) + 1, 4096)
    found, most = peak(lambda: [np.concatenate(x) for x in zip(*anchors.anchors(text, rows, 100, 400), strict=True)])
    assert found[2].sum() == (len(rows) - 1) * (4096 - 399)  # every window is in one anchor
    assert most < 64 << 20  # 203 MB before
