import pytest


@pytest.fixture()
def docs(spark):
    def make(texts, columns="doc_id long, text string, lang string, source string, n_chars long"):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, columns)

    return make
