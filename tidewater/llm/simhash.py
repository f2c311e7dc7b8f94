"""SimHash near-duplicates, linked through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ascii_words, settle, ship_package, text_or_empty, word_shingles
from tidewater.llm.components import components

BITS = 64
SEED = 42
#: Join keys of one component, so that a large one never meets in one task.
LANES = 16
#: Rows of 32 bytes that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str, width: int) -> int:
    """Bit set where over half of the shingle hashes (XXH64, seed 42; repeats count) have it; 0 without words."""
    shingles = word_shingles(ascii_words(text), width)
    if not shingles:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    votes = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 65536):
        block = hashes[a : a + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """Columns ``key``, ``sig`` (hash of the text) and ``fp`` (the 64 bits as a signed long)."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t, width) for t in s], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(key).alias("key"), F.xxhash64(text_or_empty(text)).alias("sig"), fp(text_or_empty(text)).alias("fp"))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one holds at most one of ``distance`` differing bits.

    With ``m`` segments the least differing one holds at most distance // m.
    """
    m = distance // 2 + 1
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _variants(distance: int, fp: str) -> tuple[Column, Column]:
    """Keys to join on, as two arrays of (slot, bits): what a fingerprint offers as the left and as the right side.

    Slot 0 of a segment is the segment unchanged; slot j+1 has bit j deleted.
    A pair that differs in exactly bit j of a segment meets only in that slot,
    the side with a 0 there on the left; a pair with the whole segment in
    common meets only in slot 0.  So a pair meets once per segment.
    """
    left, right = [], []
    slot = 0
    bits = F.col(fp)
    for first, width in segments(distance):
        segment = F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << width) - 1))
        exact = F.struct(F.lit(slot).alias("slot"), segment.alias("bits"))
        left.append(exact)
        right.append(exact)
        slot += 1
        for j in range(width):
            one = segment.bitwiseAND(F.lit(1 << j)) != 0
            key = F.struct(F.lit(slot).alias("slot"), segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << j))).alias("bits"))
            left.append(F.when(~one, key))
            right.append(F.when(one, key))
            slot += 1
    return F.array_compact(F.array(*left)), F.array_compact(F.array(*right))


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most ``distance`` bits, each verified.

    ``prints``: distinct ``fp``.  Pairs are checked inside the join condition,
    so candidates that fail are never rows.
    """
    offered, sought = _variants(distance, "fp")
    l = prints.select(F.col("fp").alias("a"), F.explode(offered).alias("v")).select("a", F.col("v.slot").alias("ls"), F.col("v.bits").alias("lb"))
    r = prints.select(F.col("fp").alias("b"), F.explode(sought).alias("v")).select("b", F.col("v.slot").alias("rs"), F.col("v.bits").alias("rb"))
    whole = [0]
    for _, width in segments(distance):
        whole.append(whole[-1] + width + 1)
    once = ~F.col("ls").isin(whole[:-1]) | (F.col("a") < F.col("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    met = l.join(r, (F.col("ls") == F.col("rs")) & (F.col("lb") == F.col("rb")) & once & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text", labelled: bool = False
) -> DataFrame:
    """Per row: key, fingerprint (16 hex digits), component_id (smallest key reachable over links).

    Documents link when their fingerprints differ in at most ``distance`` bits;
    equal fingerprints are one class and take part once, so copies are never
    paired.  NULL and empty texts and texts of white space have fingerprint
    zero and link like any other; NULL keys never become a component_id unless
    the whole component has none; repeated rows come back each; an empty table
    gives an empty result; other columns are not carried.  ``labelled`` adds
    llm_label (one fingerprint of the component, which tells components with
    equal or no ids apart) and llm_text_hash.
    """
    prints = settle(fingerprints(docs, width, key, text))
    classes = settle(prints.groupBy("fp").agg(F.min("key").alias("first_key")))
    # One row becomes some 70 variants: as many tasks as a shuffle has, not the few that hold the fingerprints.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = components(links(classes.select("fp").repartition(tasks, "fp"), distance))
    named = settle(classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "label", "first_key"))
    # Classes without a link are their own component; a component of many classes is met under LANES keys.
    alone = named.filter("label is null").select("fp", F.col("fp").alias("label"), F.col("first_key").alias("component_id"))
    linked = named.filter("label is not null").withColumn("lane", F.pmod(F.xxhash64("fp"), F.lit(LANES)).cast("int"))
    smallest = linked.groupBy("label").agg(F.min("first_key").alias("component_id"))
    offered = smallest.select("label", "component_id", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"))
    member = alone.union(linked.select("fp", "label", "lane").join(offered, ["label", "lane"]).select("fp", "label", "component_id"))
    member = member.withColumnRenamed("fp", "class_fp")
    out = prints.join(member, prints["fp"] == member["class_fp"])
    return out.select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        *([F.col("label").alias("llm_label"), F.col("sig").alias("llm_text_hash")] if labelled else []),
    )


def first_of_group(
    docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest key (a NULL key only where the
    component has no other), then the smallest text hash, then the smallest hash of the other columns.

    ``groups`` are the labelled near-duplicates of ``docs``; without labels they are found again,
    because ids do not tell components apart: components without any id, or an id with several texts.
    The choice is made among keys and hashes; texts meet it once, and do not move while it has at most
    ``BROADCAST_ROWS`` rows.
    """
    if "llm_label" not in groups.columns:
        groups = near_duplicates(docs, width, distance, key, text, labelled=True)
    others = [c for c in docs.columns if c not in (key, text) and not _unhashable(docs, c)]
    marks = {"llm_text_hash": F.xxhash64(text_or_empty(text)), "llm_rest_hash": F.xxhash64(F.col(text).isNull(), *others)}
    hashed = docs.withColumns(marks)
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("llm_text_hash").alias("sig")))
    named = groups.groupBy("llm_label").agg(first.alias("first")).select(F.col("first.key").alias("kept_key"), F.col("first.sig").alias("kept_sig"))
    same = hashed.groupBy(F.col(key).alias("own_key"), *marks).agg(F.count(F.lit(1)).alias("copies"))
    of_named = same.join(named, same["own_key"].eqNullSafe(named["kept_key"]) & (same["llm_text_hash"] == named["kept_sig"]))
    chosen = settle(of_named.groupBy("kept_key", "kept_sig").agg(F.min(F.struct("llm_rest_hash", "copies")).alias("one"))).select(
        "kept_key", "kept_sig", F.col("one.llm_rest_hash").alias("kept_rest"), F.col("one.copies").alias("kept_copies")
    )
    facts = chosen.agg(F.count(F.lit(1)).alias("rows"), F.max("kept_copies").alias("copies")).first()
    few = F.broadcast(chosen) if facts["rows"] <= BROADCAST_ROWS else chosen
    on = hashed[key].eqNullSafe(few["kept_key"]) & (hashed["llm_text_hash"] == few["kept_sig"]) & (hashed["llm_rest_hash"] == few["kept_rest"])
    kept = hashed.join(few, on)
    if (facts["copies"] or 0) > 1:
        # Rows that agree in everything that is hashed: one of them, the first map-side.
        again = kept.filter("kept_copies > 1").dropDuplicates([key, *marks])
        kept = kept.filter("kept_copies = 1").union(again)
    return kept.select(*[F.col(c) for c in docs.columns])


def _unhashable(df: DataFrame, column: str) -> bool:
    return any(t in df.schema[column].dataType.simpleString() for t in ("map<", "variant"))
