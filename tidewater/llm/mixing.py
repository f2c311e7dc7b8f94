"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a token budget from its weight.  A row's hash decides whether
it is taken: every source has one threshold, and rows hashed below it come in.
The threshold is found without sorting rows: tokens are summed by source and
hash bucket, the bucket in which the budget runs out is cut into finer buckets,
and so on; only rows of the boundary bucket are summed again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, settle, text_or_empty

#: Hash bits consumed by one histogram, and how many histograms are nested.
BUCKET_BITS = 12
LEVELS = 3
#: A source's rows are spread over so many join keys, so a hot source never meets in one task.
SPREAD = 64
#: Rows of one source each that are broadcast at most.
BROADCAST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """Budget of every source: shares by weight of all tokens, none above ``max_repeat`` times its own.

    ``sizes`` has one row per source (``mix_source``, ``source_size``).  Weights
    repeat over the sources in code-point order, NULL last.  What a capped
    source cannot use goes to the others by weight; that is one water level for
    which the sum of ``min(cap, level * weight)`` is the total, found with
    running sums over the sources ordered by cap / weight.
    """
    named = Window.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))]
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("nth", F.row_number().over(by_ratio))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("nth"))).over(whole)
    share = F.coalesce(level * F.col("weight"), F.col("cap"))
    return rows.select("mix_source", "source_size", F.least(share, F.col("cap")).alias("target"))


def _prefix(level: int) -> Column:
    """The first ``level`` groups of hash bits, as a number that orders like the unsigned hash."""
    return F.shiftrightunsigned("mix_hash", 64 - BUCKET_BITS * level)


def _by_source(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Join one-row-per-source facts to rows, the rows of a source spread over ``SPREAD`` keys."""
    spread = facts.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).withColumnRenamed("mix_source", "fact_source")
    salted = rows.withColumn("mix_salt", F.pmod("mix_hash", F.lit(SPREAD)).cast("int"))
    on = salted["mix_source"].eqNullSafe(spread["fact_source"]) & (salted["mix_salt"] == spread["mix_salt"])
    return salted.join(spread, on, how).drop("fact_source", "mix_salt")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash prefix below which rows come in (``cut``), so that their sizes sum nearest to ``need``.

    ``rows``: ``mix_source``, ``mix_hash``, ``size``; ``budgets``: ``mix_source``, ``need``.
    """
    state = budgets.select("mix_source", "need", F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("edge"))
    for level in range(1, LEVELS + 1):
        inside = rows if level == 1 else _by_source(rows, state.select("mix_source", "edge")).filter(_prefix(level - 1) == F.col("edge"))
        histogram = inside.groupBy("mix_source", _prefix(level).alias("bucket")).agg(F.sum("size").cast("double").alias("sum"))
        running = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        h, s = histogram.alias("h"), state.alias("s")
        steps = (
            h.join(s, F.col("h.mix_source").eqNullSafe(F.col("s.mix_source")))
            .select("s.mix_source", "need", "before", "bucket", "sum")
            .withColumn("after", F.col("before") + F.sum("sum").over(running))
        )
        # The last bucket that starts within the budget is the one to refine.
        state = (
            steps.filter(F.col("after") - F.col("sum") <= F.col("need"))
            .groupBy("mix_source", "need")
            .agg(F.max("bucket").alias("edge"), F.max_by(F.col("after") - F.col("sum"), "bucket").alias("before"), F.max_by("after", "bucket").alias("after"))
        )
    nearer = F.abs(F.col("after") - F.col("need")) <= F.abs(F.col("before") - F.col("need"))
    return state.select("mix_source", (F.col("edge") + nearer.cast("long")).alias("cut"))


def _hash(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def _facts(rows: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """Per source: source_size, target, how often every row is taken (``whole``) and the ``cut`` below which it comes once more."""
    sizes = rows.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    budgets = targets(sizes, weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0))
    whole = F.least(whole, F.lit(max_repeat)).cast("long")
    budgets = settle(
        budgets.withColumn("whole", whole)
        .withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("need", F.when(F.col("whole") >= max_repeat, F.lit(0.0)).otherwise(F.col("need")))
    )
    cuts = thresholds(rows, budgets.filter("need > 0").select("mix_source", "need"))
    c, b = cuts.alias("c"), budgets.alias("b")
    facts = b.join(c, F.col("b.mix_source").eqNullSafe(F.col("c.mix_source")), "left").select(
        "b.mix_source", "source_size", "target", "whole", F.coalesce("c.cut", F.lit(0)).alias("cut")
    )
    return settle(facts)


def _rows(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return settle(
        docs.select(
            F.col(key).alias("mix_key"), F.col(source).cast("string").alias("mix_source"), n_words(text).alias("size"), _hash(key, text).alias("mix_hash")
        )
    )


def _copies() -> Column:
    return F.col("whole") + (_prefix(LEVELS) < F.col("cut")).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """How often each document enters the mix: key, size, source, source_size, target, copies, taken.

    A source whose target is ``r`` times its size and a bit gives every
    document ``r`` times and those below its threshold once more; never more
    than ``max_repeat`` times.  The hash covers key and text, so reruns agree
    and identical rows share one decision.  NULL text has size 0; NULL is a
    source of its own, ordered last; an empty table gives an empty result; a
    table without words has targets of 0 and takes nothing.
    """
    rows = _rows(docs, key, source, text)
    return (
        _by_source(rows, _facts(rows, weights, max_repeat))
        .withColumn("copies", _copies())
        .select(
            F.col("mix_key").alias(key),
            "size",
            F.col("mix_source").alias(source),
            "source_size",
            "target",
            "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with its columns as they are.

    Every row decides by its own source's threshold, so repeated rows, NULL
    keys and several texts of one key are each taken by their own number.
    Texts do not move while there are at most ``BROADCAST_SOURCES`` sources.
    """
    facts = _facts(_rows(docs, key, source, text), weights, max_repeat)
    marked = docs.withColumns({"mix_source": F.col(source).cast("string"), "mix_hash": _hash(key, text)})
    if facts.count() <= BROADCAST_SOURCES:
        few = F.broadcast(facts.withColumnRenamed("mix_source", "fact_source"))
        met = marked.join(few, marked["mix_source"].eqNullSafe(few["fact_source"]))
    else:
        met = _by_source(marked, facts)
    counted = met.withColumn("mix_copies", _copies().cast("int")).filter("mix_copies > 0")
    return counted.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies")))).select(*docs.columns)
