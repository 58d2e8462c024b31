import pytest

LONG = "word " * 40_000


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text), with a column too many whose name clashes with results."""

    def make(rows, extra="n_words string, score string, runs string"):
        names = [x.split()[0] for x in extra.split(",") if x.strip()]
        return spark.createDataFrame([(i, t, *("x" for _ in names)) for i, t in rows], f"doc_id long, text string, {extra}")

    return make
