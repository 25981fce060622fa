"""Language: rejection of what no learned language is, letters by category, and the model against a plain refit."""

import random
import string

import numpy as np
from pyspark.sql import functions as F

from factorloom.llm import langid
from factorloom.llm.common import text_bytes


def test_letters():
    assert not any(langid.has_letter(t) for t in ("", "½", "12 ²", "Ⅳ", "①", "--- 3 !!", "_"))
    assert all(langid.has_letter(t) for t in ("a", "½ x", "é", "文", "ª", "ʰ"))


def test_gibberish_and_other_languages_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.train(docs)
    rng = random.Random(3)
    odd = [" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (30, 100, 300) for _ in range(20)]
    odd.append("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem")
    odd.append("人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。")
    rows = langid.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert not any(r.accepted for r in rows) and all(r.lang_pred in model.langs for r in rows)
    kept = langid.predict(docs, model).agg(F.avg(F.col("accepted").cast("int"))).first()[0]
    assert kept > 0.99


def test_scores_against_plain_sums(spark, documents):
    """The folded, blockwise prediction gives what each document's own histogram gives."""
    model = langid.train(documents)
    texts = [r.text for r in documents.where("text is not null").limit(40).collect()] + ["", "ab", "é" * 50]
    import pyarrow as pa

    got, strange = model.scores(*text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        h = langid.histogram(t.encode()).astype(float)
        n = max(h.sum(), 1)
        z = (h @ model.table[:-1] / n + model.bias) / model.temperature
        p = np.exp(z - z.max())
        assert np.allclose(got[k], p / p.sum(), atol=1e-5)
        assert np.isclose(strange[k], model.strangeness(h @ model.usual[:-1] / n, h.sum()), atol=1e-2)
    assert sorted(model.langs) == sorted({r.lang for r in documents.where("lang is not null").select("lang").distinct().collect()})
