import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names clash with results."""
    def make(rows, lang="en"):
        full = [(i, t, lang, "s", None if t is None else len(t), "x", 1.0) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double")

    return make
