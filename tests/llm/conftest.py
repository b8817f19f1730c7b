import pytest
from pyspark.sql import functions as F

EXTRA = {"n_values": 1, "id": 2, "node": "x", "row": "y", "draws": None}


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, source]) as a documents table with extra columns whose names clash with those used inside."""

    def make(rows, extra=True):
        rows = [(*r, None)[:3] for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        df = df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
        for name, value in EXTRA.items() if extra else ():
            df = df.withColumn(name, F.lit(value).cast("string" if value is None or isinstance(value, str) else "long"))
        return df

    return make


HARD = [
    (1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "one two three", "b"), (5, "one two three", "b"),
    (5, "one two three", "b"), (None, "no id here at all", "a"), (7, "word " * 30_000, None), (8, "x" * 50_000, "c"),
    (9, "é\u00a0ñ \u3000 日本 🦙 <turn \\<turn </turn>", "d"),
]


@pytest.fixture(scope="session")
def hard_docs(make_docs):
    """Nulls, empty and long texts, repeats and odd characters."""
    return make_docs(HARD)


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)
