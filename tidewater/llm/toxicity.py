"""Toxicity: severity grades by ordinal regression on words and stems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import settle, ship_package, text_or_empty
from tidewater.llm.ordinal import LEAST_ROWS, LEAST_Z, MOST, Ordinal, fit
from tidewater.llm.text_features import Memory, presence, word_features

#: Labelled rows the model is fitted on at most, chosen by hash (a documented bound; scoring covers all rows).
SAMPLE = 8_000


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, limit: int, key: str, text: str) -> DataFrame:
    """At most ``limit`` rows (t, g) of labelled documents, those with the smallest hashes of their key.

    Labels are cut to ``limit`` before the join (distinct keys, NULL keys and
    grades left out; of several labels of a key the smallest counts).
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(grade).isNotNull()).groupBy(key).agg(F.min(grade).alias("g"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(limit).withColumnRenamed(key, "label_key")
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return rows.join(F.broadcast(chosen), F.col("k") == F.col("label_key")).select("k", "t", F.col("g").cast("int").alias("g"))


def labelled_features(sample: DataFrame, features) -> DataFrame:
    """Features of the (bounded) sample, made and kept on the executors: row, g, f (feature numbers), v (values)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = features()
        for pdf in batches:
            found = [of(t) for t in pdf["t"]]
            yield pd.DataFrame(
                {
                    "k": pdf["k"],
                    "g": pdf["g"],
                    "f": [list(f) for f in found],
                    "v": [list(f.values()) if isinstance(f, dict) else [1.0] * len(f) for f in found],
                }
            )

    made = sample.mapInPandas(make, "k long, g int, f array<long>, v array<double>")
    return settle(made.select(F.monotonically_increasing_id().alias("row"), "k", "g", "f", "v"))


def _entries(made: DataFrame) -> DataFrame:
    return made.select("row", "g", F.explode(F.arrays_zip("f", "v")).alias("e")).select("row", "g", F.col("e.f").alias("f"), F.col("e.v").alias("v"))


def chosen_features(made: DataFrame, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z, most: int = MOST) -> list[int]:
    """The features whose value correlates with the grade: ``select_features`` as one aggregate over the sample's entries."""
    facts = made.agg(F.count(F.lit(1)).alias("n"), F.avg("g").alias("mean"), F.stddev_pop("g").alias("spread")).first()
    if not facts["n"] or not facts["spread"]:
        return []
    centered = F.col("v") * (F.col("g") - F.lit(facts["mean"]))
    sums = _entries(made).groupBy("f").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.sum(centered).alias("c")
    )
    variance = F.greatest(F.col("q") - F.col("s") * F.col("s") / facts["n"], F.lit(1e-12))
    scored = sums.filter(F.col("rows") >= least_rows).withColumn("z", F.abs("c") / (F.lit(facts["spread"]) * F.sqrt(variance)))
    best = scored.filter(F.col("z") >= least_z).orderBy(F.col("z").desc(), "f").limit(most)
    return sorted(r["f"] for r in best.select("f").collect())  # at most ``most`` numbers


def collect_chosen(made: DataFrame, chosen: list[int]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The sample's rows with their chosen features alone, and the grades: bounded by the sample times ``MOST``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.asarray(chosen, np.int64)
        for pdf in batches:
            f = [np.asarray(x, np.int64) for x in pdf["f"]]
            own = [np.isin(x, wanted) for x in f]
            yield pd.DataFrame(
                {
                    "row": pdf["row"],
                    "g": pdf["g"],
                    "f": [x[m].tobytes() for x, m in zip(f, own)],
                    "v": [np.asarray(x, np.float64)[m].tobytes() for x, m in zip(pdf["v"], own)],
                }
            )

    rows, grades = [], []
    found = made.select("row", "k", "g", "f", "v").orderBy("k", "row").select("row", "g", "f", "v")
    for r in found.mapInPandas(cut, "row long, g int, f binary, v binary").toLocalIterator():
        rows.append((np.frombuffer(r["f"], np.int64), np.frombuffer(r["v"], np.float64)))
        grades.append(r["g"])
    return rows, np.asarray(grades, np.int64)


def with_severity_grades(made: DataFrame, steps: tuple[int, ...] = (1, 4, 8)) -> DataFrame:
    """``made`` with severity grades for its toxic / clean labels: 0 clean, then by how many different telltale features a toxic row holds.

    A feature is telltale if at least five labelled rows have it and at least
    95 of 100 of them are toxic.  The labels are 0 or 1, so grades from 2 on are
    counts of the features themselves, not judgements of a reader.
    """
    entries = _entries(made)
    telltale = entries.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("bad")).filter("n >= 5 and bad >= 0.95 * n")
    hits = entries.join(telltale.select("f"), "f", "left_semi").groupBy(F.col("row").alias("hit_row")).agg(F.count(F.lit(1)).alias("hits"))
    met = made.join(hits, F.col("row") == F.col("hit_row"), "left")
    level = F.lit(0)
    for step in steps:
        level = level + (F.coalesce("hits", F.lit(0)) >= step).cast("int")
    graded = F.when(F.col("g") > 0, F.greatest(F.lit(1), level)).otherwise(F.lit(0))
    return settle(met.select("row", "k", graded.alias("g"), "f", "v"))


def _features():
    memory = Memory(word_features)
    return lambda text: presence(text, memory)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", graded: bool = False, limit: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Ordinal:
    """Fit on labelled documents; ``graded``: the label is a severity grade already, else toxic (1) or clean (0).

    At most ``limit`` labelled rows and ``MOST`` features of theirs enter the
    fit; features are chosen on the executors.
    """
    ship_package(docs.sparkSession)
    made = labelled_features(labelled_sample(docs, labels, label, limit, key, text), _features)
    made = made if graded else with_severity_grades(made)
    return fit(*collect_chosen(made, chosen_features(made)), l1=5e-5)


def with_severity(docs: DataFrame, model: Ordinal, text: str = "text", out: str = "severity") -> DataFrame:
    """``docs`` with a struct column: expected_severity, p_toxic (P(grade >= 1)), grade (the most grades with a tail of a half).

    Every other column passes through.  NULL text counts as empty and gets the
    grade of a text without features; the whole text is read; repeated rows
    score alike; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_severity: double, p_toxic: double, grade: int>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own: Ordinal = held.value
        memory = Memory(word_features, own.weights)
        for s in batches:
            # Summed in a fixed order, so that equal texts score equal to the last bit.
            z = np.array([sum(own.weights[f] for f in sorted(presence(t, memory))) for t in s], dtype=float)
            tails = own.tails(z)
            yield pd.DataFrame({"expected_severity": tails.sum(axis=1), "p_toxic": tails[:, 0], "grade": (tails >= 0.5).sum(axis=1).astype(np.int32)})

    return docs.withColumn(out, score(text_or_empty(text)))


def toxicity(docs: DataFrame, labels: DataFrame, reject: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, expected_severity, p_toxic, severity, and toxic (p_toxic at least ``reject``).

    NULL and empty texts score as a text without features; rows with NULL keys
    and repeated rows are scored each; an empty table gives an empty result;
    without labels of both kinds the model is constant.  Other columns are not
    carried.
    """
    model = train(docs, labels, key=key, text=text)
    scored = with_severity(docs.select(key, text), model, text, "llm_severity")
    return scored.select(
        key,
        "llm_severity.expected_severity",
        "llm_severity.p_toxic",
        F.col("llm_severity.grade").alias("severity"),
        (F.col("llm_severity.p_toxic") >= reject).alias("toxic"),
    )
