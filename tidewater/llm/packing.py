"""Best-two-fit packing of token sequences.

Documents become pieces of at most ``capacity`` tokens.  How pieces share
sequences depends on their lengths alone, and there are at most ``capacity``
different lengths, so the packing is planned on the histogram of lengths: a
plan line says "so many sequences hold these lengths".  Every piece then finds
its place from its rank among the pieces of its length.  The histogram and the
plan are bounded by ``capacity``, whatever the number of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import bpe
from tidewater.llm.common import settle, ship_package, text_or_empty


def _best_pair(counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum within ``room``."""
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return None
    floor = np.zeros(room + 1, np.int64)  # floor[r]: the largest unpacked length within r
    floor[have] = have
    floor = np.maximum.accumulate(floor)
    first = have[have < room]
    second = floor[room - first]
    alone = (second == first) & (counts[first] < 2)
    if alone.any():  # a single piece cannot be both
        second[alone] = floor[np.maximum(first[alone] - 1, 0)]
    good = second > 0
    if not good.any():
        return None
    total = np.where(good, first + second, 0)
    at = int(total.argmax())
    return int(first[at]), int(second[at])


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Sequences as (how many, lengths in each), covering the histogram exactly.

    Fill greedily: the longest piece left, then again and again the longest
    that fits.  Then best-two-fit: if there is a gap, take out the smallest
    piece and put in two unpacked ones that fill the widened gap more tightly,
    while that helps.  The pattern is used for as many sequences as the counts allow.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    lines = []
    top = capacity
    while True:
        while top > 0 and counts[top] == 0:
            top -= 1
        if top == 0:
            return lines
        left, bin_, gap = counts.copy(), [], capacity
        while gap > 0:
            fits = np.flatnonzero(left[1 : gap + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            take = min(int(left[length]), gap // length)
            bin_ += [length] * take
            left[length] -= take
            gap -= take * length
        while gap > 0 and len(bin_) > 1:
            smallest = bin_[-1]
            pair = _best_pair(left, gap + smallest)
            if pair is None or sum(pair) <= smallest:
                break
            left[smallest] += 1
            left[pair[0]] -= 1
            left[pair[1]] -= 1
            gap += smallest - sum(pair)
            bin_ = sorted(bin_[:-1] + list(pair), reverse=True)
        lengths, uses = np.unique(bin_, return_counts=True)
        times = int((counts[lengths] // uses).min())
        counts[lengths] -= times * uses
        lines.append((times, bin_))


def slots(lines: list[tuple[int, list[int]]], capacity: int) -> list[np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces in a sequence, offset) ordered by first rank."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    used = [0] * (capacity + 1)
    sequence = 0
    for times, bin_ in lines:
        offset = 0
        for length in sorted(set(bin_), reverse=True):
            uses = bin_.count(length)
            out[length].append((used[length], sequence, uses, offset))
            used[length] += times * uses
            offset += uses * length
        sequence += times
    return [np.asarray(rows, np.int64).reshape(-1, 4) for rows in out]


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: all hold ``capacity`` but the first, which takes what is over."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str, text: str, payload: str) -> DataFrame:
    """Tokenise and cut: key, piece, start, length, payload, and the place of origin (part, nth of its length there)."""
    spark = docs.sparkSession
    ship_package(spark)
    whole = spark.sparkContext.broadcast(bpe.whole_tokens(tokenizer))
    key_type = docs.schema[key].dataType
    with_ids = payload == "ids"
    schema = T.StructType(
        [
            T.StructField("k", key_type),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("payload", T.BinaryType() if with_ids else T.LongType()),
            T.StructField("part", T.LongType()),
            T.StructField("nth", T.LongType()),
        ]
    )
    end = np.uint32(end_id).astype("<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(tokenizer, whole.value)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, piece, start, length, load, part, nth = [], [], [], [], [], [], []
            parts = batch.column(2).to_pylist()
            for row, t in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(t) + end
                n = len(ids) // 4
                starts = cut_points(n, capacity)
                for p, a in enumerate(starts):
                    z = starts[p + 1] if p + 1 < len(starts) else n
                    own = ids[4 * a : 4 * z]
                    rows.append(row)
                    piece.append(p)
                    start.append(a)
                    length.append(z - a)
                    load.append(own if with_ids else zlib.crc32(own))
                    part.append(parts[row])
                    nth.append(int(seen[z - a]))
                    seen[z - a] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(load, pa.binary() if with_ids else pa.int64()),
                    pa.array(part, pa.int64()),
                    pa.array(nth, pa.int64()),
                ],
                names=["k", "piece", "start", "length", "payload", "part", "nth"],
            )

    narrow = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"), F.spark_partition_id().cast("long").alias("part"))
    return narrow.mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 1024,
    key: str = "doc_id",
    text: str = "text",
    payload: str = "ids",
) -> DataFrame:
    """Pack documents into as few sequences of ``capacity`` tokens as best-two-fit finds.

    A document is its ids and then ``end_id`` (NULL or empty text: only that);
    one longer than ``capacity`` is cut into pieces of ``capacity``, the first
    taking what is over.  Per piece: key, piece, start, length, sequence_id,
    offset, and ``ids`` (``payload="ids"``: little-endian 32-bit) or ``ids_crc32``
    (``payload="crc32"``).  Pieces never overlap and leave no gap before an
    offset.  Repeated rows and NULL keys are packed like any other row; an
    empty table gives an empty result; other columns are not carried.
    """
    cut = settle(pieces(docs, tokenizer, end_id, capacity, key, text, payload))
    tally = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tally = settle(tally.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    # At most one row per length: bounded by the capacity.
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity), capacity))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for own in np.unique(lengths):
            at = np.flatnonzero(lengths == own)
            rows = table.value[own]
            row = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
            nth = ranks[at] - row[:, 0]
            sequence[at] = row[:, 1] + nth // row[:, 2]
            offset[at] = row[:, 3] + nth % row[:, 2] * own
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = cut.join(tally.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.withColumn("place", place("length", "rank")).select(
        F.col("k").alias(key),
        "piece",
        "start",
        "length",
        F.col("payload").alias("ids" if payload == "ids" else "ids_crc32"),
        "place.sequence_id",
        "place.offset",
    )
