import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (id, text) pairs, with columns that clash with names inside the operators."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame([(*r, "en", "s", 0, 1, 2, "x") for r in rows] or [], f"{schema}, lang string, source string, n_chars long, id long, score long, removed string")
        return df

    return make
