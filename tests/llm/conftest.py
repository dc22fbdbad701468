import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text[, lang[, source]]) tuples."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
