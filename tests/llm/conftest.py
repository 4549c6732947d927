import random

import pytest
from llm_helpers import prose
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that clash with the operators' own."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 40) for _ in range(600))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s"), (2, None, "en", None), (3, "", None, "s"), (4, long, "en", "s"), (5, long, None, "s"), (None, "alpha beta", "en", "s"),
        (7, "!!! 123 ???", "en", "s"), (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s"), (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s"), (9, "  \n\t ", "fr", "s"), (None, None, None, None),
        (10, "été ça où 日本語 😀 ▁ x", "fr", "s"), (11, "x" * 120_000, "en", "s"),
    ]
    clash = ["id", "row", "h", "t", "n", "dk", "key", "fp", "text_hash", "keep", "kept", "pos", "line", "token", "w", "p", "start", "score", "spans", "slice", "salt", "pattern", "emptied", "carried", "lines", "n_lines", "_row", "stay"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in clash:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
