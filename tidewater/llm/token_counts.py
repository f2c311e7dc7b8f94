"""Token counts by the whole-token shortcut (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bpe
from tidewater.llm.common import ship_package, text_or_empty


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with a column of token counts; every other column passes through.

    NULL text counts as empty (0 tokens); an existing column named ``out`` is
    replaced; repeated rows are counted each; an empty table gives an empty one.
    The tokenizer file has the same path on every executor; the set of whole
    tokens (bounded by the vocabulary) travels with the function.
    """
    spark = docs.sparkSession
    ship_package(spark)
    whole = spark.sparkContext.broadcast(bpe.whole_tokens(tokenizer))

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = bpe.load(tokenizer, whole.value)
        for s in texts:
            yield pd.Series([encoder.count(t) for t in s], dtype="int64")

    return docs.withColumn(out, n_tokens(text_or_empty(text)))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""
    counted = with_token_counts(docs.select(key, text), tokenizer, text, "n_tokens")
    return counted.select(
        key,
        F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
