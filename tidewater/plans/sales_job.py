"""spark-submit entry point of the monthly sales report.

    spark-submit --py-files tidewater.zip tidewater/plans/sales_job.py --month 2024-11 \\
        --sales s3a://lake/sales --products s3a://lake/products --output s3a://lake/sales_report
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans.sales_report import (
    backfill_reports,
    monthly_sales_report,
    persist_report,
    persist_reports,
    report_target_name,
    validate_month,
)
from tidewater.session import build_session
from tidewater.sources import documents, files


def _load(spark: SparkSession, kind: str, location: str, fmt: str, args: argparse.Namespace) -> DataFrame:
    if kind == "file":
        return files.read(spark, files.FileOptions(path=location, format=fmt))
    if kind == "mongodb":
        return documents.mongo_read(spark, documents.MongoOptions(args.mongo_uri, args.mongo_database), location)
    if kind == "arangodb":
        opts = documents.ArangoOptions(args.arango_endpoints, args.arango_database, args.arango_user, args.arango_password)
        return documents.arango_read_all(spark, opts, location)
    raise ValueError(f"unknown source kind {kind!r}")


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sales-report", description="Monthly sales report")
    p.add_argument("--month", help="YYYY-MM; default: this month in Asia/Kolkata")
    p.add_argument("--months", help="comma list of YYYY-MM: all in one scan and one write (file output)")
    p.add_argument("--sales", required=True, help="path, or collection for document stores")
    p.add_argument("--sales-kind", default="file", choices=["file", "mongodb", "arangodb"])
    p.add_argument("--sales-format", default="parquet")
    p.add_argument("--products", required=True)
    p.add_argument("--products-kind", default="file", choices=["file", "mongodb", "arangodb"])
    p.add_argument("--products-format", default="parquet")
    p.add_argument("--output", help="report root for files; one month=YYYY-MM folder per run")
    p.add_argument(
        "--output-kind", default="file", choices=["file", "mongodb", "arangodb"],
        help="document stores get one collection per month, sales_report_YYYY_MM, replaced on rerun",
    )
    p.add_argument("--output-format", default="parquet")
    p.add_argument("--partition-col", help="yyyy-MM partition column of the sales source")
    p.add_argument("--lenient", action="store_true", help="dirty numbers become NULL instead of failing")
    p.add_argument("--mongo-uri")
    p.add_argument("--mongo-database")
    p.add_argument("--arango-endpoints")
    p.add_argument("--arango-database", default="_system")
    p.add_argument("--arango-user", default="root")
    p.add_argument("--arango-password", default="")
    return p.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    sales = _load(spark, args.sales_kind, args.sales, args.sales_format, args)
    products = _load(spark, args.products_kind, args.products, args.products_format, args)
    if args.months:
        if args.output_kind != "file" or not args.output:
            raise ValueError("--months writes files: give --output")
        months = [m.strip() for m in args.months.split(",") if m.strip()]
        reports = backfill_reports(sales, products, months, decimals=None, lenient=args.lenient)
        persist_reports(reports, args.output, args.output_format, months)
        return ",".join(sorted(set(months)))
    month = validate_month(args.month)
    report = monthly_sales_report(
        sales, products, month, decimals=None, lenient=args.lenient, sort=False, partition_col=args.partition_col
    )
    if args.output_kind == "file":
        if not args.output:
            raise ValueError("--output is required for file output")
        persist_report(report, args.output, month, args.output_format)
    elif args.output_kind == "mongodb":
        opts = documents.MongoOptions(args.mongo_uri, args.mongo_database)
        documents.mongo_write(report, opts, report_target_name(month), mode="overwrite")
    else:
        opts = documents.ArangoOptions(args.arango_endpoints, args.arango_database, args.arango_user, args.arango_password)
        documents.arango_write(report, opts, report_target_name(month), mode="overwrite")
    return month


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    spark = build_session(app_name="sales-report")
    run(spark, args)


if __name__ == "__main__":
    main()
