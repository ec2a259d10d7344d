import pytest

# Small literal tables of the tests: (name, type) pairs and rows.
TEXT_ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(texts, sources=None, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, TEXT_ROWS)
    return make
