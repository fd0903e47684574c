from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `fp` string, `word` int"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls everywhere, empty and very long texts, repeated rows, and columns whose names clash with inner ones."""
    base = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees above us"
    rows = [
        (1, base, "en", "a", 5, "x", 1), (1, base, "en", "a", 5, "x", 1), (2, base, None, "a", None, None, None), (3, None, "en", None, None, None, None), (4, "", "en", "a", 0, "y", 2),
        (None, base, None, None, None, None, None), (None, None, None, None, None, None, None), (5, LONG, "en", "b", 1, "z", 3), (6, "mail a.b@c.example.com or +1 (743) 555-3824 now", "en", "b", 1, "z", 3), (7, "é \U0001f600 ### <|endoftext|>\n\n", "fr", "b", 1, "z", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(odd_documents: DataFrame) -> DataFrame:
    return odd_documents.filter("false")


@pytest.fixture(scope="session")
def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
