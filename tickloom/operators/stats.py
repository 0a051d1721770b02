"""Run statistics of collectors and queries."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.numbers import steady_round

RUN_LOG_SCHEMA = (
    "module string, unique_id string, started timestamp, duration_ms double, "
    "n_events long, rejected long, cleanups long, deleted long, error string"
)


def run_stats(log: DataFrame) -> DataFrame:
    """Per collector: runs, errors, events, mean time, last run, clean-ups.

    The last error is the error text of the newest run, blank when that run
    succeeded. Failed runs count as runs and leave the mean time as it is. Log
    rows without a start are clean-ups and not runs.
    """
    is_run, failed = F.col("started").isNotNull(), F.col("error").isNotNull()
    return log.groupBy("module", "unique_id").agg(
        F.count_if(is_run).alias("runs_count"),
        F.count_if(failed).alias("errors_count"),
        F.coalesce(F.sum(F.when(~failed, F.col("n_events"))), F.lit(0)).alias("collected_events"),
        F.ceil(F.round(F.coalesce(F.avg(F.when(~failed, F.col("duration_ms"))), F.lit(0.0)), 9))
        .cast("long")
        .alias("avg_execution_time_ms"),
        F.max("started").alias("last_execution_time"),
        F.coalesce(F.max_by("error", "started"), F.lit("")).alias("error_message"),
        F.coalesce(F.sum("cleanups"), F.lit(0)).alias("cleanup_times"),
        F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted_events_count"),
    )


REQUEST_LOG_SCHEMA = "key string, duration_ms double, failed boolean"


def request_key(name: str, **params: object) -> str:
    """The text that calls with equal parameters share; parameters that are not set are left out."""
    given = {"name": name, **{k: v for k, v in sorted(params.items()) if v is not None}}
    return ";".join(f"{k}={v}" for k, v in given.items())


@contextmanager
def recorded_request(spark: SparkSession, path: str, name: str, **params: object) -> Iterator[None]:
    """Append the block's call to the request log that `query_stats` reads. A call
    that raises is recorded as failed, and raises."""
    began, failed = time.monotonic(), True
    try:
        yield
        failed = False
    finally:
        took = (time.monotonic() - began) * 1000
        row = spark.createDataFrame([(request_key(name, **params), took, failed)], REQUEST_LOG_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(path)


def query_stats(log: DataFrame) -> DataFrame:
    """Per request key: calls, errors, mean and longest time of successful calls."""
    ok = ~F.col("failed")
    took = F.when(ok, F.col("duration_ms"))
    return log.groupBy(F.col("key").alias("api_name")).agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.count_if(~ok).alias("total_errors"),
        steady_round(F.coalesce(F.avg(took), F.lit(0.0)), 2).alias("avg_response_time_ms"),
        F.round(F.coalesce(F.max(took), F.lit(0.0)), 2).alias("max_response_time_ms"),
    )
