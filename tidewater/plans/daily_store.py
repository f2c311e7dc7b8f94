"""Incremental report: daily sums are kept, a refresh scans only the days that are missing.

The store holds one partial sum per product and day.  Every load adds the days
after the newest loaded one, in folders by month and load, and is committed by
one small file that names its days.  What a load that died has left is not
named anywhere, so it is never read; the next load sums the same days anew.  A
day belongs to one load, so a month is the union of its days.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.datetime import month_range, wall_clock_literal, zoned_literal
from tidewater.operators.columns import require_columns
from tidewater.plans.sales_report import build_report, sale_amount
from tidewater.session import path_exists

DAY = "sale_date"
_LOADS = "first DATE, last DATE, load INT"


def _between(sales: DataFrame, first: _dt.date | None, last: _dt.date) -> DataFrame:
    """Sales from ``first`` (no bound if None) to ``last``, both included, as a range the scan can push down."""
    kind = sales.schema["timestamp"].dataType
    if not isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        raise ValueError("incremental loads need a timestamp column")
    literal = wall_clock_literal if isinstance(kind, T.TimestampNTZType) else zoned_literal
    midnight = lambda d: literal(_dt.datetime(d.year, d.month, d.day))
    rows = sales.filter(F.col("timestamp") < midnight(last + _dt.timedelta(days=1)))
    return rows if first is None else rows.filter(F.col("timestamp") >= midnight(first))


class DailyStore:
    """Daily sums per product below ``path``; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, product_type: T.DataType | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType(
            [
                T.StructField("product_id", product_type or T.LongType()),
                T.StructField("daily_sale_amount", T.DoubleType()),
                T.StructField(DAY, T.DateType()),
            ]
        )

    def loads(self) -> DataFrame:
        """``load``, ``first`` (NULL: no bound), ``last``: the days of every committed load."""
        if not path_exists(self.spark, f"{self.path}/loads"):
            return self.spark.createDataFrame([], _LOADS)
        return self.spark.read.schema(_LOADS).json(f"{self.path}/loads")

    def loaded_until(self) -> _dt.date | None:
        """High-water mark: the last day of the newest load."""
        return self.loads().agg(F.max("last").alias("d")).first()["d"]

    def read(self, month: str | None = None) -> DataFrame:
        """``product_id``, ``daily_sale_amount``, ``sale_date`` of one month (its folders only) or of all."""
        loads = self.loads()
        if month is not None:
            start, end = month_range(month)
            loads = loads.filter((F.col("last") >= F.lit(start.date())) & (F.col("first").isNull() | (F.col("first") < F.lit(end.date()))))
        known = [r["load"] for r in loads.select("load").collect()]  # one per refresh
        if not known:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField("month", T.StringType()), T.StructField("load", T.IntegerType())])
        sums = self.spark.read.schema(stored).parquet(f"{self.path}/sums").filter(F.col("load").isin(known))
        return (sums if month is None else sums.filter(F.col("month") == month)).select(*self.schema.names)

    def load(self, sales: DataFrame, until: _dt.date, lenient: bool = False) -> tuple[_dt.date | None, _dt.date]:
        """Add the days after the newest loaded one up to ``until``, a day that is over; returns (loaded before, until).

        Only sales of those days are read.  Loading up to a day that has been
        reached does nothing.
        """
        require_columns(sales, "timestamp", "product_id", "price", "quantity")
        before = self.loaded_until()
        if before is not None and before >= until:
            return before, until
        first = before and before + _dt.timedelta(days=1)
        number = (self.loads().agg(F.max("load").alias("n")).first()["n"] or 0) + 1
        daily = _between(sales, first, until).select(
            "product_id", F.to_date("timestamp").alias(DAY), sale_amount(lenient=lenient).alias("sale_amount")
        ).groupBy("product_id", DAY).agg(F.sum("sale_amount").alias("daily_sale_amount"))
        rows = daily.select(*self.schema.names, F.substring(F.col(DAY).cast("string"), 1, 7).alias("month"), F.lit(number).alias("load"))
        rows = rows.hint("rebalance", F.col("month")).sortWithinPartitions("month", DAY, "product_id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "load").parquet(f"{self.path}/sums")
        named = self.spark.createDataFrame([(first, until)], "first DATE, last DATE")
        named.coalesce(1).write.mode("overwrite").json(f"{self.path}/loads/load={number}")
        return before, until

    def report(self, products: DataFrame, month: str, decimals: int | None = 2, sort: bool = True) -> DataFrame:
        """The monthly report from stored days: reads the folders of that month, no sales."""
        return build_report(self.read(month), products, decimals, sort=sort)
