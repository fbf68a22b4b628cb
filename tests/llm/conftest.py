import pytest

EXTRA = ", score double, fp long, text_key string, _id string, root string, n string"


@pytest.fixture(scope="session")
def docs_frame(spark):
    """A documents table from (doc_id, text) with extra columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None, 0.5, 7, "k", "x", "r", "n") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long" + EXTRA).repartition(3)
    return make
