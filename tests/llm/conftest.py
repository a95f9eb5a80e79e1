import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (doc_id, text, lang, source) tuples; ids count up where none are given."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, *rest = row if isinstance(row, tuple) else (i, row)
            lang, source = [*rest, "en", "s"][:2] if rest else ("en", "s")
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def odd_documents(documents):
    """NULLs in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    rows = [
        (1, None, None, None), (2, "", "en", None), (None, "some words here", "en", "a"), (None, None, None, None),
        (3, "some words here", "en", "a"), (3, "some words here", "en", "a"), (3, "other words", None, "b"),
        (4, "word " * 30000, "en", "a"), (5, " \n\t ", "en", "a"), (6, "é" * 50, "fr", "b"),
    ]
    return documents(rows).withColumns({n: F.lit(7) for n in ("key", "fp", "root", "n", "size", "id", "hash", "taken", "row", "node", "digest")})
