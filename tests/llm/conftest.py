import pytest

SF001 = "/root/testdata/sf0.001"
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, row long, run int, digest string, kind int, "
           "size int, node long, label int, h long, dim int, term string, __s string, score double")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF001}/labels.parquet")


def _rows(texts):
    return [(i, t, lang, source, len(t or ""), 1, 2, "x", 3, 4, 5, 6, 7, 8, "t", "s", 0.5) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows,
    and extra columns with names that operators use."""
    long = " ".join(f"wort{i % 997} und" for i in range(30_000))
    return spark.createDataFrame(_rows([
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (2, "The quick  brown\tfox jumps over the lazy dog.", "en", None),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \n\t ", None, "b"),
        (6, long, "de", "c"),
        (7, long + " ende", "de", "c"),
        (8, "12345 +++ 4111 1111 1111 1111 x@y.org", "fr", "a"),
        (9, "émile zola écrivit naïvement à Σίσυφος", "fr", ""),
        (None, "one two", "en", "a"),
        (None, "one two", None, "a"),
    ]), COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
