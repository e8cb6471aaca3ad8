import pytest


@pytest.fixture()
def docs_of(spark):
    """A documents table from texts, with columns that operators must ignore."""

    def make(texts, start=0):
        rows = [(start + i, t, "xx", "src", "clash", True) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, norm string, kept boolean")

    return make
