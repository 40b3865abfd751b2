"""Tables for the tests of this folder."""

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """``documents`` from ``(doc_id, text[, lang[, source]])`` tuples."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def awkward():
    """NULL, empty, blank, one-word and very long texts, repeated rows and a NULL id."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n\x0b\f\r ", "en", "a"),
        (4, "word", "en", None),
        (5, long, "en", "b"),
        (6, "Same words here, same words here.\n\nÉté ÀB", "fr", "b"),
        (6, "Same words here, same words here.\n\nÉté ÀB", "fr", "b"),
        (None, "no id at all for this text", "en", "a"),
        (8, "!!! ### 123", "de", "c"),
    ]
