import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string, size string, ids string, kept string"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest table of documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    extra = ["c", "s", "z", "i", "k"]
    rows = [
        (1, same, "en", "a"), (1, same, "en", "a"), (2, same, "en", None), (3, None, None, "b"), (4, "", "en", "b"), (None, same, "en", "a"), (None, None, None, None),
        (5, " \t\n", "fr", "b"), (6, long, "en", "a"), (7, long + " tail", "en", "b"), (8, "one two", "en", "a"), (9, "one  TWO", None, "b"), (10, "é😀 ß İ token = \"0123456789aeiou-Q1W2E3R4\"", "de", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, *extra) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
