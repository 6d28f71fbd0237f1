import pytest
from pyspark.sql import types as T

LONG = "The wanders of the long text go on and on. " * 4000

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("n_words", T.StringType()),
        T.StructField("key", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("score", T.StringType()), T.StructField("drops", T.StringType()), T.StructField("n.dot", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def table(spark):
    """Rows (id, text) as a table with further columns whose names clash with those that the operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", "z", "u", "s", "d", "n") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank and very long texts, repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (None, "no id here at all"), (None, None), (5, "a row twice"), (5, "a row twice"), (6, "ünï çødé 漢字 🙂 text"), (7, "x" * 70_000)]
