"""The query's own number of segmentations: several words of a document are searched, and the N best are exact."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from factorloom.llm import lattice, pieces, queries
from factorloom.llm.common import text_bytes

from .test_operators import segmentations


@pytest.fixture(scope="module")
def vocab():
    return lattice.load_vocab(pieces.MODEL)


def test_the_query_searches_several_words(spark, sf_dir):
    rows = queries.op6_sentencepiece(spark, sf_dir).collect()
    long = [r for r in rows if r.n_pieces > 100]
    assert long and all(len(r.scores) >= 8 and r.scores == sorted(r.scores, reverse=True) for r in long)
    assert sum(len({p for c in r.changed_words for p in c}) > 1 for r in long) > len(long) / 2


def test_default_against_all_segmentations(vocab):
    texts = ["the hat of", "thouhe  n\nq", "", "é𓀀ok an on", "a", "the hat of"]
    score = lambda p, k: vocab.unknown_score if p == vocab.unknown else float(vocab.scores[p])
    e = pieces.Encoder(vocab)
    for _ in range(2):  # the second time from what is remembered
        _, _, scores, changes, _ = e.step(*text_bytes(pa.array(texts)))
        for t, s, c in zip(texts, scores, changes, strict=True):
            want = [w[0] for w in segmentations(vocab, (" " + t).encode(), score)[: pieces.N_BEST]] if t else [0.0]
            assert s == want and len(c) == len(s) and len({str(x) for x in c}) == len(c)


def test_a_long_word_keeps_few_hypotheses(vocab):
    text = ("aaa𓀀" * 3000).encode()
    lat = lattice.build(vocab, np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
    score = np.where(lat.piece == vocab.unknown, vocab.unknown_score, vocab.scores[lat.piece])
    alpha = lattice.forward(lat, score)
    tracemalloc.start()
    try:
        found = lattice.n_best(lat, score, alpha, 0, 8)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len({tuple(p) for _, p in found}) == 8
    assert most < 700 * len(text)
