"""Small frames with the awkward rows every operator has to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(9000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nIt barks.", "en", "a", 54),
    (2, "The quick brown fox jumps over the lazy dog.\nIt barks.", "en", "a", 54),
    (2, "The quick brown fox jumps over the lazy dog.\nIt barks.", "en", "a", 54),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "  \t\n ", "en", "b", 5),
    (6, LONG, "en", "b", len(LONG)),
    (7, "É<|endoftext|>ß  中文 😀 don't", "fr", None, 20),
    (8, "one", "en", "c", 3),
    (None, "no key here at all, sorry", "en", "c", 25),
]


def awkward(spark: SparkSession) -> DataFrame:
    """Ties, repeats, NULLs, empty and long texts, and extra columns with names the operators use."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("score", "taken", "size", "fingerprint", "sequence_id", "label", "rank", "k", "t"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
