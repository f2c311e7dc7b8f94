"""Quality: expected grade and tail probability by ordinal regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ship_package, text_or_empty
from tidewater.llm.ordinal import Ordinal, fit
from tidewater.llm.text_features import REPEATED, Memory, looks, presence, shape_features, word_features
from tidewater.llm.toxicity import chosen_features, collect_chosen, labelled_features, labelled_sample

#: Labelled rows the model is fitted on at most, chosen by hash (a documented bound; scoring covers all rows).
SAMPLE = 8_000


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Graded rating of a label row: 0 poor, 1 fair (good prose, but abusive), 2 good; NULL without a quality label."""
    return F.when(F.col(quality) == 0, 0).when(F.coalesce(F.col(toxic), F.lit(0)) > 0, 1).when(F.col(quality).isNotNull(), 2)


def _features():
    words, shapes = Memory(word_features), Memory(shape_features)
    return lambda text: {f: 1.0 for f in presence(text, words)} | looks(text, shapes)


def train(docs: DataFrame, labels: DataFrame, grade: str, limit: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Ordinal:
    """Fit on documents whose ``grade`` (integers from 0) is known: at most ``limit`` rows, and ``MOST`` features of theirs."""
    ship_package(docs.sparkSession)
    made = labelled_features(labelled_sample(docs, labels, grade, limit, key, text), _features)
    return fit(*collect_chosen(made, chosen_features(made)))


def with_quality(docs: DataFrame, model: Ordinal, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column: expected_grade and tail_probability (P(grade >= 1)).

    Every other column passes through.  NULL text counts as empty and is scored
    as a text without features; the whole text is read; repeated rows score
    alike; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade: double, tail_probability: double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own: Ordinal = held.value
        words, shapes = Memory(word_features, own.weights), Memory(shape_features, own.weights)
        repeated = own.weights.get(REPEATED, 0.0)

        def z(text: str) -> float:
            seen = looks(text, shapes)
            total = sum(own.weights[f] for f in sorted(presence(text, words)))
            return total + sum(own.weights[f] * seen[f] for f in sorted(seen) if f != REPEATED) + repeated * seen.get(REPEATED, 0.0)

        for s in batches:
            tails = own.tails(np.array([z(t) for t in s], dtype=float))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, 0]})

    return docs.withColumn(out, score(text_or_empty(text)))


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, expected_grade, tail_probability, and keep (tail probability at least ``least``).

    NULL and empty texts score as a text without features; rows with NULL keys
    and repeated rows are scored each; an empty table gives an empty result;
    without two different ratings the model is constant.  Other columns are not
    carried.
    """
    model = train(docs, labels.withColumn("llm_rating", rating()), "llm_rating", key=key, text=text)
    scored = with_quality(docs.select(key, text), model, text, "llm_quality")
    return scored.select(
        key,
        "llm_quality.expected_grade",
        "llm_quality.tail_probability",
        (F.col("llm_quality.tail_probability") >= least).alias("keep"),
    )
