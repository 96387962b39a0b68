import pytest


@pytest.fixture
def docs(spark):
    """Make a documents table from (doc_id, text) pairs, with extra columns whose names clash with results."""
    def make(*pairs):
        rows = [(i, t, None, None, None, "x", "y") for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, length string")

    return make
