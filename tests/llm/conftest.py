import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with an extra column and null rows allowed."""

    def make(rows, *more):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        data = [(i, t, lang, source, None if t is None else len(t), "extra") for i, t, lang, source in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
