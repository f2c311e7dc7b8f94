"""Exact record numbers and deep pages: equal to a sort, without one task that sorts or merges the table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.plan_utils import explain_text
from tidewater.operators.rank_index import build_rank_index

KEYS = [("k", False), ("id", True)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.hash("id") % 50))
    return rows.repartition(6)


@pytest.fixture(scope="module")
def index(frame):
    return build_rank_index(frame, KEYS, ranges=8)


def in_order(frame):
    rows = [(r["id"], r["k"]) for r in frame.collect()]
    return sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))


def test_numbers_are_those_of_a_sort(frame, index):
    got = {r["record_number"]: (r["id"], r["k"]) for r in index.numbered().collect()}
    assert got == dict(enumerate(in_order(frame), 1))
    assert index.total == 5000


@pytest.mark.parametrize("number,size", [(0, 10), (249, 10), (499, 10), (500, 10), (3, 700), (0, 0), (7, 5000)])
def test_pages_at_any_depth(frame, index, number, size):
    plain = in_order(frame)[number * size : (number + 1) * size]
    rows = sorted(index.page(number, size, "record_number").collect(), key=lambda r: r["record_number"])
    assert [(r["id"], r["k"]) for r in rows] == plain
    assert [r["record_number"] for r in rows] == list(range(number * size + 1, number * size + 1 + len(plain)))


def test_a_page_reads_only_the_ranges_it_overlaps(index):
    folders = {f.split("_range=")[1].split("/")[0] for f in index.page(249, 10).inputFiles()}
    assert len(folders) <= 2
    plan = explain_text(index.page(249, 10))
    assert "Exchange" not in plan and "TakeOrdered" not in plan and "Sort" not in plan


def test_hot_key_is_spread_by_the_later_keys(index):
    rows = [r["rows"] for r in index.starts().collect()]
    # A third of the rows share k; the unique last key still cuts them into even ranges.
    assert len(rows) >= 6 and max(rows) < 2 * 5000 / len(rows)


def test_empty_table_bad_pages_and_reserved_names(spark):
    none = build_rank_index(spark.range(0), [("id", True)])
    assert none.total == 0 and none.page(0, 5).collect() == [] and none.numbered().collect() == []
    with pytest.raises(ValueError):
        none.page(-1, 5)
    with pytest.raises(ValueError):
        build_rank_index(spark.range(1).withColumn("_range", F.lit(1)), [("id", True)])


def test_ascending_nulls_come_first(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "k INT")
    rows = build_rank_index(df, [("k", True)]).numbered(first=0).collect()
    assert {r["record_number"]: r["k"] for r in rows} == {0: None, 1: 1, 2: 2}
