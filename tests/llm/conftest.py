import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, source]) rows, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), 7, "x", 1.5) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id long, h string, size double")

    return make
