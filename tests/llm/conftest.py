import pytest


@pytest.fixture
def make_docs(spark):
    """Rows (doc_id, text) as a documents table with an extra column of a clashing name."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t or ""), "x") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, kept string",
        )

    return make
