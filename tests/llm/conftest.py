import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with the other columns of documents."""

    def make(rows, source="s"):
        return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, blanks, repeated rows, a null id, a long text and ties."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "One  two\nthree"), (7, "a b c d e f g h"),
        (7, "a b c d e f g h"), (None, "a b c d e f g h i j"), (8, long), (9, long + " end"), (10, "ünï cödé " * 40),
    ]
