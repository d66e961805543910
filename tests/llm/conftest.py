import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash."""

    def make(*rows, columns=""):
        schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, size string, id string, band string"
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, schema)

    return make
