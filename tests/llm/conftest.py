from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t-\r]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns that operators use for themselves."""
    long = "one two three four five six seven eight nine ten " * 3000
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "src0", 0),
        (3, " \n\t ", "en", None, 4),
        (4, long, None, "src0", len(long)),
        (4, long, None, "src0", len(long)),
        (5, "The quick brown fox jumps over the lazy dog", "en", "src1", 43),
        (6, "the QUICK brown fox jumps over the lazy dog", "de", "src1", 43),
        (None, "The quick brown fox jumps over the lazy dog", "en", "src1", 43),
        (None, "a text of its own, which no other row has", "en", "src1", 41),
        (None, None, None, None, None),
        (7, "é 日本 😀 x", "xx", "src9", 8),
        (8, "x" * 5000, "en", "src0", 5000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("score", "kept", "node", "label", "block", "ids", "n_tokens", "bucket", "rank", "v", "weight", "place"):
        df = df.withColumn(c, F.lit("theirs"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
