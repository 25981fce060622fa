"""N best segmentations under ties and on long words."""

import time

import numpy as np
import pytest

from factorloom.llm import lattice, pieces


@pytest.fixture(scope="module")
def vocab():
    return lattice.load_vocab(pieces.MODEL)


def one(vocab, word):
    data = np.frombuffer(word.encode(), np.uint8)
    lat = lattice.build(vocab, data, np.array([0]), np.array([len(data)]))
    return lat, np.where(lat.piece == vocab.unknown, vocab.unknown_score, vocab.scores[lat.piece])


@pytest.mark.parametrize("word", ["aaa𓀀" * 3, "abcabcab", "hello", "ababababab", "ééé", "文字文字", " the"])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 20])
def test_ties(vocab, word, n):
    lat, score = one(vocab, word)
    every = []

    def go(node, total, path):
        if node == lat.base[0] + lat.length[0]:
            every.append((total, path))
        for k in np.flatnonzero(lat.src == node):
            go(lat.dst[k], total + score[k], (*path, int(lat.piece[k])))

    go(lat.base[0], 0.0, ())
    got = lattice.n_best(lat, score, lattice.forward(lat, score), 0, n)
    assert np.allclose([s for s, _ in got], sorted((s for s, _ in every), reverse=True)[:n])
    assert len({tuple(p) for _, p in got}) == len(got) and {tuple(p) for _, p in got} <= {p for _, p in every}


@pytest.mark.parametrize("text", ["aaa𓀀" * 5000, "ab" * 150_000, "x" * 100_000])
def test_long_words(vocab, text):
    began = time.time()
    data = np.frombuffer(text.encode(), np.uint8)
    ids, bound, scores, _, same = pieces.Encoder(vocab, 3).step(data, np.array([0, len(data)]))
    assert same.all() and bound[-1] == len(ids) and len(scores[0]) == 3 and time.time() - began < 30


def test_sweeps_agree(vocab, monkeypatch):
    """Edge by edge and place by place, all scores are the same."""
    words = [" hello", "aaaa", " 文字", "abcabc", " the"] * 3
    data, ends = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([len(w.encode()) for w in words])
    found = []
    for thin in (0, 10**9):
        monkeypatch.setattr(lattice, "_THIN", thin)
        lat = lattice.build(vocab, data, np.concatenate([[0], ends[:-1]]), ends)
        score = vocab.scores[lat.piece]
        alpha = lattice.forward(lat, score)
        path, count = lattice.best_paths(lat, lattice.best_edges(lat, score, alpha))
        small = -np.abs(score) / 1e4
        found.append([alpha, path, count, lattice.gaps(lat, score, alpha, path), lattice.forward(lat, small, True), lattice.backward(lat, small)])
    for a, b in zip(*found, strict=True):
        assert np.allclose(a, b)


def test_decoded_is_of_the_row(vocab):
    encoder = pieces.Encoder(vocab, 1)
    data, at = np.frombuffer(b"one two", np.uint8), np.array([0, 3, 7])
    ids, bound, *_ = encoder.step(data, at)
    spaced, where = pieces._spaced(data, at)
    wrong = ids.copy()
    wrong[bound[1]] = ids[0]
    assert encoder._restored(ids, bound, spaced, where).tolist() == [True, True]
    assert encoder._restored(wrong, bound, spaced, where).tolist() == [True, False]
