"""The pipeline's suffix stage cuts every repeated passage of over 50 words, and every repeated string of 400 bytes."""

import re
from collections import Counter

import numpy as np
import pytest

from factorloom.llm import suffixdedup

pipeline = pytest.importorskip("corpus_pipeline")


def cut(texts, words=51, span=400):
    """Brute force on bytes."""
    at = [[m.span() for m in re.finditer(rb"[^\t-\r ]+", t)] for t in texts]
    runs = [[tuple(t[a:z] for a, z in w[i : i + words]) for i in range(len(w) - words + 1)] for t, w in zip(texts, at, strict=True)]
    seen, bytes_ = Counter(r for x in runs for r in x), Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t, w, x in zip(texts, at, runs, strict=True):
        on = np.zeros(len(t), bool)
        for i, r in enumerate(x):
            if seen[r] > 1:
                on[w[i][0] : w[i + words - 1][1]] = True
        for i in range(len(t) - span + 1):
            if bytes_[t[i : i + span]] > 1:
                on[i : i + span] = True
        out.append(b"".join(t[a:z].decode("utf-8", "ignore").encode() for a, z in zip(*suffixdedup.runs(~on), strict=True)))
    return out


def test_short_passages(spark):
    def own(k, n):
        return " ".join(f"w{k}x{i}" for i in range(n))

    passage, fifty = " ".join(f"p{i}" for i in range(51)), " ".join(f"q{i}" for i in range(50))
    texts = [f"{own(1, 30)} {passage} {own(2, 30)}", f"{passage}\n{own(3, 9)}", f"{own(4, 5)} {fifty} {own(5, 5)}", f"{fifty} {own(6, 5)}", own(7, 80), own(7, 40).replace(" ", "\n"), "x" * 900]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text.encode() for r in pipeline.suffix_array(spark, df, "").collect()}
    assert [got[i] for i in sorted(got)] == cut([t.encode() for t in texts])
    assert b"p7 " not in got[0] + got[1] and fifty.encode() in got[2] and fifty.encode() in got[3]


@pytest.mark.parametrize("options", [{}, {"hot_bytes": 2000}, {"shard_bytes": 10_000}])
def test_passages(documents, options):
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: (r.text or "").encode() for r in suffixdedup.remove(documents, words=(suffixdedup.WORDS, suffixdedup.WORD_GRAM), **options).collect()}
    assert [got[r.doc_id] for r in rows] == cut([(r.text or "").encode() for r in rows])
