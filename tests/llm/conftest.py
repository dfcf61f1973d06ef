import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from texts, or from whole rows, with a column whose name operators may use themselves."""

    def make(texts, extra=False):
        rows = [t if isinstance(t, tuple) else (i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOC)
        return df.selectExpr("*", "'x' AS row", "1 AS kept", "2 AS counts", "3 AS copied_0", "4 AS node", "5 AS gone", "6 AS gone_0", "7 AS copied_1_id") if extra else df

    return make
