import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, long texts, ties, repeated rows, and further columns whose names an operator might use itself."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, k long, row string, spans string, label int, fp string, accepted string"
    more = (1, "r", "s", 2, "f", "a")
    long = " ".join(f"word{i % 701} alpha{i % 13}" for i in range(6000))
    rows = [
        (1, None, "en", "a", 0, *more),
        (2, "", "en", "a", 0, *more),
        (3, " \n\t ", "en", None, 0, *more),
        (4, long, "en", "a", 0, *more),
        (5, long, "en", "a", 0, *more),
        (5, long, "en", "a", 0, *more),
        (None, "The quick brown fox, jumps over the lazy dog. Ünïcödé 文字 text", "en", "a", 0, *more),
        (7, "12345 --- !!", None, "a", None, *more),
        (8, "x" * 3000, "fr", "a", 0, *more),
        (9, "la maison est à côté de la forêt", "fr", "a", 0, *more),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
