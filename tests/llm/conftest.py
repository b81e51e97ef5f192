import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Make a documents table from (doc_id, text) pairs, with columns whose names clash with inner ones."""
    def make(rows, schema="doc_id long, text string, lang string, row int, component int, spans string, score string"):
        return spark.createDataFrame([(i, t, "en", 1, 2, "x", "y") for i, t in rows], schema)

    return make
