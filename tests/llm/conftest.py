import pytest

DOCS = "doc_id bigint, text string, label int, n bigint, score double"


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """The session with its shared folder set."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture
def make_docs(shared):
    """Documents with extra columns whose names the operators use themselves."""

    def make(pairs):
        return shared.createDataFrame([(i, t, 1, 2, 0.5) for i, t in pairs], DOCS)

    return make


#: Null id and text, empty and blank texts, a repeated row, a very long text.
ODD = [(None, None), (None, "x"), (1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "word " * 30_000), (6, "9" * 50_000)]
