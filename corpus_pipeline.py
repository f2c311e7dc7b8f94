"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

1. quality classifier: rows below the tail probability go;
2. toxicity: rows at or above the toxic probability go;
3. SimHash near-duplicates: one document of each group stays;
4. mixing sources to target weights: rows come out as often as the mix takes them;
5. best-fit packing: the pieces of every row in sequences of 1024 tokens.

All but the last return the columns of ``documents``.  Both classifiers are
fitted on documents of their own input with labels from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import mixing, packing, quality, simhash, toxicity
from tidewater.llm.common import read_table
from tidewater.session import scratch_path

KEEP_QUALITY = 0.5
REJECT_TOXIC = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of at least a fair grade reaches ``KEEP_QUALITY``.

    NULL and empty texts are judged as texts without features, rows with NULL
    ids and repeated rows each by their text; an empty table stays empty.
    """
    labels = read_table(spark, sf_dir, "labels").withColumn("llm_rating", quality.rating())
    model = quality.train(docs, labels, "llm_rating")
    scored = quality.with_quality(docs, model, out="llm_quality")
    return scored.filter(F.col("llm_quality.tail_probability") >= KEEP_QUALITY).drop("llm_quality")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of any toxicity stays below ``REJECT_TOXIC``; NULLs, repeats and empty tables as before."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.with_severity(docs, model, out="llm_severity")
    return scored.filter(F.col("llm_severity.p_toxic") < REJECT_TOXIC).drop("llm_severity")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group: that with the smallest id; repeated rows of it count once.

    All texts without words (NULL, empty, white space) are one group; rows with
    NULL ids form groups like others; an empty table stays empty.
    """
    groups = simhash.near_duplicates(docs, width=4, distance=4, labelled=True)
    return simhash.first_of_group(docs, groups, width=4, distance=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, repeated rows by their own number; rows without words are in no mix of words
    unless their source is taken whole."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequence and offset; NULL and empty texts are one end token, repeated rows each a document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, payload="crc32")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers, fingerprints and tokens are not expressible in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last goes through Parquet in the shared folder.

    Extra columns of ``documents`` pass to the packing stage, whatever their
    names; an empty table gives an empty result.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "corpus", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
