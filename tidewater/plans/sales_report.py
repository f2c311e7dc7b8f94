"""Monthly sales report.

Plan shape: Parquet scan with the month range pushed down -> partial hash
aggregate on (product, day) -> exchange -> final aggregate -> join with the
product dimension (AQE turns it into a broadcast when the measured side is
small) -> range exchange -> sort.  Aggregating before the join keeps the join
input at (products sold x days) rows whatever the raw sales volume is.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.datetime import (
    IST,
    current_year_month,
    month_range,
    parse_year_month,
    wall_clock_literal,
    zoned_literal,
)
from tidewater.functions.text import dash_to_underscore
from tidewater.operators.columns import require_columns

REPORT_PREFIX = "sales_report_"


def validate_month(month: str | None, today: _dt.date | None = None, zone: str = IST) -> str:
    """Month parameter: defaults to this month in ``zone``, never in the future."""
    this_month = current_year_month(zone, today)
    if month is None:
        return this_month
    parse_year_month(month)
    if month > this_month:
        raise ValueError(f"Job date: {month} can not be in future (now {this_month})")
    return month


def month_filter(df: DataFrame, month: str, ts_col: str = "timestamp") -> DataFrame:
    """Rows whose timestamp text starts with ``month``.

    On a timestamp column the prefix test is rewritten as a half-open range
    with literals of the column's own type, which Parquet can push down
    (``PushedFilters: GreaterThanOrEqual, LessThan``).  NULLs drop out.
    """
    require_columns(df, ts_col)
    dtype = df.schema[ts_col].dataType
    c = F.col(ts_col)
    if isinstance(dtype, T.StringType):
        parse_year_month(month)
        return df.filter(c.startswith(month))
    start, end = month_range(month)
    if isinstance(dtype, T.TimestampNTZType):
        lo, hi = wall_clock_literal(start), wall_clock_literal(end)
    elif isinstance(dtype, T.DateType):
        lo, hi = F.lit(start.date()), F.lit(end.date())
    else:
        # TIMESTAMP (with local time zone): a literal wall clock read in the
        # session zone, the same zone the reference's string cast uses.
        lo, hi = zoned_literal(start), zoned_literal(end)
    return df.filter((c >= lo) & (c < hi))


def sale_day(df: DataFrame, ts_col: str = "timestamp") -> Column:
    """Calendar day of the sale.

    Timestamps are grouped as a DATE (4 bytes) instead of a 10-character
    string and rendered ``yyyy-MM-dd`` only after aggregation, on far fewer
    rows.  Text timestamps keep their first ten characters as they are.
    """
    dtype = df.schema[ts_col].dataType
    c = F.col(ts_col)
    if isinstance(dtype, T.StringType):
        return F.substring(c, 1, 10)
    return F.to_date(c)


def day_text(day: Column | str, dtype: T.DataType) -> Column:
    """The ``yyyy-MM-dd`` text of a day key from ``sale_day``."""
    c = F.col(day) if isinstance(day, str) else day
    return c if isinstance(dtype, T.StringType) else F.date_format(c, "yyyy-MM-dd")


def sale_amount(price: Column | str = "price", quantity: Column | str = "quantity", lenient: bool = False) -> Column:
    """``price`` as double times ``quantity`` as int.

    ``lenient`` uses ``try_cast`` so dirty text becomes NULL instead of
    failing the job under ANSI mode.  Numeric text such as ``"17.0"`` is read
    as a number first and then truncated to an int, as a numeric column is;
    only text that is no number at all becomes NULL.
    """
    p = F.col(price) if isinstance(price, str) else price
    q = F.col(quantity) if isinstance(quantity, str) else quantity
    if lenient:
        return p.try_cast("double") * q.try_cast("double").try_cast("int")
    return p.cast("double") * q.cast("int")


def daily_sales(sales: DataFrame, month: str, lenient: bool = False, partition_col: str | None = None) -> DataFrame:
    """Sum of sale amounts per product and day of ``month``.

    Output: ``product_id``, ``sale_date`` (DATE, or text for text timestamps),
    ``daily_sale_amount``.
    """
    require_columns(sales, "timestamp", "product_id", "price", "quantity")
    in_month = month_filter(sales, month)
    if partition_col is not None:
        require_columns(sales, partition_col)
        in_month = in_month.filter(F.col(partition_col) == month)
    return (
        in_month.select(
            "product_id",
            sale_day(in_month).alias("sale_date"),
            sale_amount(lenient=lenient).alias("sale_amount"),
        )
        .groupBy("product_id", "sale_date")
        .agg(F.sum("sale_amount").alias("daily_sale_amount"))
    )


def build_report(daily: DataFrame, products: DataFrame, decimals: int | None = 2, sort: bool = True) -> DataFrame:
    """Join daily sums with product names, rename, sort.

    Inner join: sales without a product drop out; two products with one name
    stay two rows.  The product side is reduced to the two columns needed.
    ``sort=False`` skips the global sort (a sampling job plus a range
    exchange) for writers that only need each file sorted.
    """
    require_columns(products, "product_id", "product_name")
    sale = F.col("daily_sale_amount")
    if decimals is not None:
        sale = F.round(sale, decimals)
    report = daily.join(products.select("product_id", "product_name"), "product_id", "inner").select(
        F.col("product_name").alias("product"),
        day_text("sale_date", daily.schema["sale_date"].dataType).alias("date"),
        sale.alias("sale"),
    )
    return report.orderBy("product", "date") if sort else report


@dataclass
class ReportPipeline:
    """Five replaceable steps (K01): load sales, aggregate, load products, build, persist."""

    load_sales: Callable[[], DataFrame]
    aggregate: Callable[[DataFrame], DataFrame]
    load_products: Callable[[], DataFrame]
    build: Callable[[DataFrame, DataFrame], DataFrame]
    persist: Callable[[DataFrame], None] | None = None

    def run(self) -> DataFrame:
        aggregated = self.aggregate(self.load_sales())
        report = self.build(aggregated, self.load_products())
        if self.persist is not None:
            self.persist(report)
        return report


def monthly_sales_report(
    sales: DataFrame,
    products: DataFrame,
    month: str,
    decimals: int | None = 2,
    lenient: bool = False,
    sort: bool = True,
    partition_col: str | None = None,
) -> DataFrame:
    """The whole report for one month.

    ``partition_col`` names a ``yyyy-MM`` partition column of a
    month-partitioned sales source, so the scan prunes to one folder.
    """
    return ReportPipeline(
        load_sales=lambda: sales,
        aggregate=lambda s: daily_sales(s, month, lenient=lenient, partition_col=partition_col),
        load_products=lambda: products,
        build=lambda d, p: build_report(d, p, decimals, sort=sort),
    ).run()


def month_spans(months: list[str]) -> list[tuple[_dt.datetime, _dt.datetime]]:
    """Half-open ranges that cover the sorted months, neighbouring months as one."""
    spans: list[tuple[_dt.datetime, _dt.datetime]] = []
    for start, end in map(month_range, months):
        if spans and spans[-1][1] == start:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
    return spans


def backfill_reports(
    sales: DataFrame,
    products: DataFrame,
    months: list[str],
    decimals: int | None = 2,
    lenient: bool = False,
) -> DataFrame:
    """Reports of several months in one pass: ``product, date, sale, month``.

    One scan of just these months (their ranges are pushed down, neighbours
    as one), one aggregate on (month, product, day), one join.  Each month's rows equal
    ``monthly_sales_report`` for that month; ``persist_report``-style
    dynamic overwrite then replaces exactly those months.
    """
    if not months:
        raise ValueError("at least one month is required")
    ordered = sorted({validate_month(m) for m in months})
    require_columns(sales, "timestamp", "product_id", "price", "quantity")
    dtype = sales.schema["timestamp"].dataType
    if isinstance(dtype, T.StringType):
        scoped = sales.filter(F.substring("timestamp", 1, 7).isin(ordered))
    else:
        lit = wall_clock_literal if isinstance(dtype, T.TimestampNTZType) else zoned_literal
        c = F.col("timestamp")
        scoped = sales.filter(reduce(or_, [(c >= lit(first)) & (c < lit(last)) for first, last in month_spans(ordered)]))
    day = sale_day(scoped)
    month = F.substring(day.cast("string"), 1, 7)
    daily = (
        scoped.select("product_id", day.alias("sale_date"), month.alias("month"), sale_amount(lenient=lenient).alias("sale_amount"))
        .where(F.col("month").isin(ordered))
        .groupBy("month", "product_id", "sale_date")
        .agg(F.sum("sale_amount").alias("daily_sale_amount"))
    )
    sale = F.col("daily_sale_amount")
    if decimals is not None:
        sale = F.round(sale, decimals)
    return daily.join(products.select("product_id", "product_name"), "product_id", "inner").select(
        F.col("product_name").alias("product"),
        day_text("sale_date", daily.schema["sale_date"].dataType).alias("date"),
        sale.alias("sale"),
        "month",
    )


def persist_reports(reports: DataFrame, path: str, fmt: str = "parquet", months: list[str] | None = None) -> None:
    """Write several months at once under ``month=YYYY-MM``; only those months are replaced.

    ``months``: the months asked for; one without rows is replaced by an empty
    folder.  Without it, months that have no rows keep what they held.  A
    rebalance on the month keeps the number of files from growing with the
    tasks; a large month still gets several.
    """
    rows = reports.hint("rebalance", F.col("month")).sortWithinPartitions("month", "product", "date")
    if months is not None:
        rows = rows.persist(StorageLevel.DISK_ONLY)  # products x days, read twice
    try:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("month")
            .format(fmt)
            .save(path)
        )
        if months is not None:
            found = {r["month"] for r in rows.select("month").distinct().collect()}  # at most the months asked for
            for month in sorted(set(months) - found):
                persist_report(reports.drop("month").limit(0), path, month, fmt)
    finally:
        if months is not None:
            rows.unpersist()


def report_target_name(month: str) -> str:
    """``sales_report_2024_11``."""
    parse_year_month(month)
    return REPORT_PREFIX + month.replace("-", "_")


def report_target_column(month_col: Column | str) -> Column:
    return F.concat(F.lit(REPORT_PREFIX), dash_to_underscore(month_col))


def persist_report(report: DataFrame, path: str, month: str, fmt: str = "parquet") -> None:
    """Write one month's report under ``month=YYYY-MM``.

    The month's own folder is overwritten, so a rerun does not duplicate rows
    (the reference appends) and a rerun without rows leaves the month empty.
    Rows are sorted within each file; no single-task global sort is forced on
    the write.
    """
    parse_year_month(month)
    report.sortWithinPartitions("product", "date").write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/month={month}")


def read_report(spark, path: str, month: str, fmt: str = "parquet") -> DataFrame:
    """One month back from the partitioned report; the filter prunes partitions."""
    return (
        spark.read.format(fmt)
        .load(path)
        .filter(F.col("month") == month)
        .select("product", "date", "sale")
    )
