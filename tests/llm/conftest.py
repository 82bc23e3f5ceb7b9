import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows."""

    def frame(rows, lang=None):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return frame
