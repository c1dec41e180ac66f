import pytest

LONG = "the quick brown fox jumps over the lazy dog " * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies in another case, repeated rows, clashing extra columns."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 1), (2, "alpha BETA gamma delta epsilon zeta", "en", "a", 2),
        (3, None, None, None, None), (4, "", "en", "b", 0), (5, "   ", "de", "b", 0), (6, LONG, "en", "b", 5), (7, LONG + " end", "fr", None, 6),
        (None, "Alpha beta gamma delta epsilon zeta", "en", "a", 1), (8, "one", "en", "c", 1), (9, "one two", "en", "c", 2),
        (9, "one two", "en", "c", 2), (10, "É é Ünïcode straße 漢字 😀 ▁ \t\x0b x", "de", "c", 3), (11, "x" * 20000, "xx", "d", 4),
    ]
    df = spark.createDataFrame([(*r, f"extra{i}", i, "clash") for i, r in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, n_chars long, key string, n int, label string")
    return df


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("false")


def documents(sf):
    import pyarrow.parquet as pq
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()
