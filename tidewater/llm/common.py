"""Shared by the operators: reading, materialising, ASCII words, shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import checkpoint_root

#: A word is a run without ASCII white space (space and 0x09 to 0x0D).
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, whatever their import path: a zip of its sources, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tidewater-src-"), "tidewater_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lineage ends, lost executors cost nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows; none if it is empty."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def ascii_words(text: str) -> list[bytes]:
    """Words of a text with A-Z lowered, as UTF-8; ``bytes.split`` cuts at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_shingles(words: list[bytes], width: int) -> list[bytes]:
    """All runs of ``width`` words joined by a space, repeats kept; the whole sequence if it is shorter; none if empty."""
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    line = b" ".join(words)
    starts, ends, at = [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return [line[a:b] for a, b in zip(starts, ends[width - 1 :])]
