import pytest
from pyspark.sql import functions as F

WORDS = "the cat sat on a mat while grey rain fell over old stone walls near seven quiet green hills and rivers".split()


def long_text(n):
    return " ".join(f"{WORDS[i % len(WORDS)]}{i % 37}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "The cat sat on the mat.", "en", "s", 23),
        (1, "The cat sat on the mat.", "en", "s", 23),
        (2, None, "en", "s", None),
        (3, "", None, None, 0),
        (None, "no id here", "en", "s", 10),
        (4, long_text(60_000), "en", None, 1),
        (5, " \t\n ", "en", "s", 4),
        (6, "é " * 50, "fr", "s", 100),
        (7, "12345 67", "en", "s", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = {"Text": "x", "a.b": 1, "block": 9, "row": "r", "node": 0}
    return docs.select("*", *(F.lit(v).alias(name) for name, v in more.items()))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
