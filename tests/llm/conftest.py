import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with the operators' own."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 0, "b", False, 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long, key string, kept boolean, row int")

    return make
