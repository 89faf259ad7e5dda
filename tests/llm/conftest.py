import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, shard string, size string"
LONG = " ".join(f"word{k % 997} and" for k in range(30_000))

ODD = [
    (1, None, None, None, 0), (2, "", "en", "b", 0), (3, " \t\n ", "en", "b", 4), (4, "one two three", "en", "a", 13), (5, "One TWO three", "en", "a", 13),
    (6, LONG, "en", "a", len(LONG)), (7, LONG + " end", "en", "b", len(LONG) + 4), (8, "É grün\nnaïve 日本語 😀", "fr", "b", 18), (9, "same text here for ties of words " * 3, None, "a", 99), (10, "same text here for ties of words " * 3, "de", None, 99),
    (10, "same text here for ties of words " * 3, "de", None, 99), (10, "the other text of a repeated id", "de", "a", 31), (None, "a row without an id is still a row", "de", "c", 34), (None, None, None, "c", 0),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def odd_path(odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    odd.write.parquet(path)
    return path


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def none_path(none, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    none.write.parquet(path)
    return path


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
