"""The two job entry points, on files."""

from __future__ import annotations

import os

from tidewater.plans import sales_job, views
from tidewater.plans.sales_report import read_report
from tidewater.streaming import log_job

SF = "/root/testdata/sf0.001"


def test_sales_job(spark, tmp_dir):
    sales, products, out = (os.path.join(tmp_dir, d) for d in ("sales", "products", "out"))
    views.sales(spark, SF).write.parquet(sales)
    views.products(spark, SF).write.parquet(products)
    args = sales_job.parse_args(["--month", "1998-03", "--sales", sales, "--products", products, "--output", out])
    assert sales_job.run(spark, args) == "1998-03"
    sales_job.run(spark, args)  # rerun replaces the month
    assert read_report(spark, out, "1998-03").count() == 72


def test_log_job_on_files(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "in")
    views.log_lines(spark, SF).write.text(landing)
    expected = views.table(spark, SF, "events").where("event_type = 'error'").count()
    for sink in ("files", "table"):
        out = os.path.join(tmp_dir, "out-" + sink)
        args = log_job.parse_args(
            ["--source", "files", "--path", landing, "--sink", sink, "--sink-path", out,
             "--checkpoint", os.path.join(tmp_dir, "ck-" + sink), "--available-now", "--max-attempts", "1"]
        )
        log_job.run(spark, args)
        log_job.run(spark, args)  # restart from the checkpoint: nothing new, nothing twice
        assert spark.read.parquet(out).count() == expected


def test_sales_job_document_output_needs_connector(spark, tmp_dir):
    import pytest

    from tidewater.sources.errors import ConnectorUnavailable

    sales, products = os.path.join(tmp_dir, "s"), os.path.join(tmp_dir, "p")
    views.sales(spark, SF).write.parquet(sales)
    views.products(spark, SF).write.parquet(products)
    args = sales_job.parse_args(
        ["--month", "1998-03", "--sales", sales, "--products", products, "--output-kind", "arangodb",
         "--arango-endpoints", "h:8529"]
    )
    with pytest.raises(ConnectorUnavailable):
        sales_job.run(spark, args)


def test_sales_job_backfill(spark, tmp_dir):
    sales, products, out = (os.path.join(tmp_dir, d) for d in ("sales", "products", "out"))
    views.sales(spark, SF).write.parquet(sales)
    views.products(spark, SF).write.parquet(products)
    args = sales_job.parse_args(
        ["--months", "1998-02,1998-03", "--sales", sales, "--products", products, "--output", out]
    )
    assert sales_job.run(spark, args) == "1998-02,1998-03"
    assert read_report(spark, out, "1998-03").count() == 72
