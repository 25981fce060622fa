"""The corpus pipeline: every stage against brute force on its own input."""

import pytest
from pyspark.sql import functions as F

from .test_operators import leaks
from .test_pipeline_copies import kept as stay
from .test_pipeline_passages import cut

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir, documents):
    docs = documents
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language", "simhash", "suffix", "decontam", "pieces"]
    kept = stages["language"](spark, docs, sf_dir).persist()
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()

    one = stages["simhash"](spark, kept, sf_dir).persist()
    assert sorted(r.doc_id for r in one.collect()) == stay([(r.doc_id, r.text) for r in kept.collect()])

    out = stages["suffix"](spark, one, sf_dir).persist()
    before, after = {r.doc_id: r for r in one.collect()}, {r.doc_id: r for r in out.collect()}
    order = sorted(before)
    for d, want in zip(order, cut([before[d].text.encode() for d in order]), strict=True):
        assert after[d].text.encode() == want and after[d].n_chars == len(after[d].text)

    clean = stages["decontam"](spark, out, sf_dir).persist()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {x[0] for x in leaks([(d, after[d].text) for d in order], bench) if x[-1]}
    assert {r.doc_id for r in clean.collect()} == set(order) - bad

    out = stages["pieces"](spark, clean, sf_dir)
    assert out.count() == clean.count() and out.columns == ["doc_id", "n_pieces", "ids", "scores"]


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0


def test_odd_rows(spark, sf_dir, odd, none):
    for name, stage in pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count()
            assert name == "pieces" or out.columns == docs.columns
    kept = pipeline.near_duplicates(spark, odd.where(F.col("doc_id").isNull()), sf_dir)
    assert kept.count() == 1
