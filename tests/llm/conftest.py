import pytest


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text[, source]) with columns that operators don't read."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), 1, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n long, token string").repartition(3)

    return make
