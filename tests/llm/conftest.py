"""Fixtures of the training-data operators: awkward tables."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
#: Extra columns named like what operators add or use inside.
CLASHING = ["kept", "size", "row", "n_words", "shard", "fingerprint", "spans", "_turn", "_raw", "block", "target",
            "chunk", "size_before", "_pid", "component_id", "features", "score", "length", "piece"]


def odd_rows():
    long_text = " ".join(f"word{i % 997} of" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(120))
    return [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 10),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n\x0b\x0c\r ", "en", None, 7),
        (None, "null id, mail a.b@c.de and 10.0.0.1", "fr", "b", 9),
        (None, None, "fr", "b", None),
        (6, long_text, "en", "a", len(long_text)),
        (7, f"before {passage} after", "de", "c", None),
        (8, f"other words first {passage}", "de", "c", None),
        (9, "x" * 3000, "en", "a", 3000),
        (10, "über straße 　 naïve 日本語 \U0001f600 <|endoftext|> é", "de", "é", 3),
        (11, "don't we'll 've  two   blanks\n\n\nlines'", "en", "a", 3),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    from pyspark.sql import functions as F
    return odd_docs.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()

