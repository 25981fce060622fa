"""A benchmark item without an id counts as a hit, as in the SQL; only the list of ids leaves it out."""

from factorloom.llm import decontam
from factorloom.llm.common import whole_row


def test_null_items(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing of it"), (3, " ".join(words[:13]))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(words[5:25])), (7, " ".join(words[:13]))], "item_id long, text string")
    for block_bytes in (decontam.BLOCK_BYTES, 50):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated, list(r["items"])) for r in decontam.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
        assert got == {1: (25, 1, True, ['7']), 2: (0, 0, False, []), 3: (13, 1, True, ['7'])}
    only = decontam.find_contamination(docs, bench.where("item_id is null"))
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in only.collect()} == {1: (20, 0, True), 2: (0, 0, False), 3: (0, 0, False)}


def test_ids_of_any_type_and_hidden_names(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, words, "x", "y", "z"), (1, words, "x", "y", "z"), (2, None, None, None, None)], "doc_id long, text string, _hits string, _items string, key string")
    bench = spark.createDataFrame([("b", words), ("a", words)], "item_id string, text string")
    for block_bytes in (decontam.BLOCK_BYTES, 50):
        found = decontam.find_contamination(docs, bench, block_bytes=block_bytes, carry=whole_row(docs))
        got = sorted((r.row.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect())
        assert got == [(1, 20, 20, ["a", "b"]), (1, 20, 20, ["a", "b"]), (2, 0, 0, [])]
        assert found.schema["row"].dataType.names == docs.columns
