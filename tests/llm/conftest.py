import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """Documents from texts, with the columns of the documents table."""

    def make(texts, sources=None, langs=None, ids=None):
        n = len(texts)
        rows = list(zip(ids or range(n), texts, langs or ["en"] * n, sources or ["a"] * n, [len(t or "") for t in texts]))
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def sf():
    return SF
