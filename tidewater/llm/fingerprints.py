"""Document fingerprints, and how they tell an edited text and a neighbouring document apart."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import oph
from tidewater.llm.common import ship_package, text_or_empty


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the packed fingerprint as hex text; empty for a text without words (NULL counts as empty)."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([oph.pack(oph.minima(t)).hex() for t in s], dtype="object")

    return docs.withColumn(out, fp(text_or_empty(text)))


def _heads(rows: DataFrame, n: int) -> list[tuple[bool, int, int]]:
    """First (no key, ~key, text hash) of at most ``n`` even ranges, largest keys first, NULL keys last.

    ``rows``: the three columns ``none``, ``down``, ``h``, without texts; one row per range comes back.
    """
    ranged = rows.repartitionByRange(n, "none", "down", "h")
    first = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("none", "down", "h")).alias("head"))
    return sorted({(r["head"]["none"], r["head"]["down"], r["head"]["h"]) for r in first.collect()})


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare with both the edit and the next document.

    The edited text has its last third (``floor(n_chars / 3)`` code points)
    replaced by the first as many (or all) of the next document in descending
    key order; after the last comes the first.  Returns key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Keys are integers; NULL keys come last; equal keys are ordered by a hash of
    their text.  NULL text is empty; a lone document is its own next one; an
    empty table gives an empty result; other columns are not carried.

    Plan: ranges of (key, text hash) are cut without texts, so equal and NULL
    keys spread over ranges too; range i then is task i.  One shuffle brings the
    texts of a range together, sorted.  The only texts that go to two ranges are
    those equal to a range's first row, so that the range before it ends with
    its true successor.  The driver sees one row of numbers per range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    key_type = docs.schema[key].dataType
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ~k falls as k rises, for every long.
    down = F.bitwise_not(F.coalesce(F.col("k").cast("long"), F.lit(0).cast("long")))
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).withColumns(
        {"none": F.col("k").isNull(), "down": down, "h": F.xxhash64("t")}
    )
    heads = _heads(rows.select("none", "down", "h"), n)
    last = len(heads) - 1

    @F.pandas_udf("array<int>")
    def places(none: pd.Series, down: pd.Series, h: pd.Series) -> pd.Series:
        """Its range, and for a row equal to a range's first also the range before it (around the end), as -1 - range."""
        out = []
        for row in zip(none.tolist(), down.tolist(), h.tolist()):
            r = max(0, bisect.bisect_right(heads, row) - 1)
            out.append([r, -1 - (r - 1 if r else last)] if row == heads[r] else [r])
        return pd.Series(out)

    dealt = (
        rows.withColumn("place", F.explode(places("none", "down", "h")))
        .withColumn("tail", F.col("place") < 0)
        .withColumn("r", F.when(F.col("tail"), -1 - F.col("place")).otherwise(F.col("place")))
        .repartitionById(max(1, len(heads)), "r")
        .sortWithinPartitions("r", "tail", "none", "down", "h", "t")
        .select("k", "t", "r", "tail")
    )
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (key, text, packed, range) still without a successor
        for batch in batches:
            rows = []
            for k, t, r, tail in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if tail and (held is None or held[3] != r):
                    continue  # more rows with the first key than the one successor needed
                packed = oph.pack(oph.minima(t))
                if held is not None:
                    own, text_, print_, _ = held
                    cut = len(text_) // 3
                    edited = text_[: len(text_) - cut] + t[:cut]
                    edited_print = oph.pack(oph.minima(edited)) if edited != text_ else print_
                    rows.append(
                        (
                            own,
                            len(text_),
                            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            print_.hex(),
                            edited_print.hex(),
                            oph.likeness(print_, edited_print),
                            oph.likeness(print_, packed),
                        )
                    )
                held = None if tail else (k, t, packed, r)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow_schema)], schema=arrow_schema
                )

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)
    return dealt.mapInArrow(compare, schema)
