"""Runs read from a task-execution store (the tables Spring Cloud Task keeps).

``TASK_EXECUTION`` holds one row per run; ``TASK_EXECUTION_PARAMS`` one row
per argument.  The mapping is a DataFrame transform, so it runs on any
source of the same shape; ``read_task_store`` loads both tables over JDBC
with split reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources import jdbc

# Table and column names of the task store.
EXECUTION_TABLE = "TASK_EXECUTION"
PARAMS_TABLE = "TASK_EXECUTION_PARAMS"


def runs_from_task_tables(executions: DataFrame, params: DataFrame) -> DataFrame:
    """Task tables -> the ``runs`` shape used by ``plans.runs``.

    Arguments are gathered per execution with a partial aggregate (a run has
    a handful of arguments); runs without arguments get an empty list.  The
    store keeps no argument order, so the list order is not defined.
    """
    args = params.groupBy("TASK_EXECUTION_ID").agg(F.collect_list("TASK_PARAM").alias("arguments"))
    joined = executions.join(args, "TASK_EXECUTION_ID", "left")
    return joined.select(
        F.col("TASK_NAME").alias("job_name"),
        F.col("TASK_EXECUTION_ID").cast("long").alias("execution_id"),
        F.col("EXTERNAL_EXECUTION_ID").alias("correlation_id"),
        F.col("START_TIME").cast("timestamp_ntz").alias("start_time"),
        F.col("END_TIME").cast("timestamp_ntz").alias("end_time"),
        F.col("EXIT_CODE").cast("int").alias("exit_code"),
        F.coalesce(F.col("arguments"), F.array().cast("array<string>")).alias("arguments"),
        F.col("EXIT_MESSAGE").alias("stored_exit_message"),
        F.col("ERROR_MESSAGE").alias("error_message"),
    )


def read_task_store(spark: SparkSession, opts: jdbc.JdbcOptions) -> DataFrame:
    """Both tables over JDBC (split by ``opts.partition_column`` when set)."""
    executions = jdbc.read_table(spark, opts, EXECUTION_TABLE)
    params = jdbc.read_table(spark, opts, PARAMS_TABLE)
    return runs_from_task_tables(executions, params)
