"""Continuous ingest of log folders and pushed documents into the event table."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.session import stored
from tickloom.sources.event_store import append_events
from tickloom.sources.logs import LogFormat, as_events, parse_lines
from tickloom.sources.push import accepted_events, outcomes
from tickloom.sources.tail import started_lines
from tickloom.streaming.landing import land, landed, triggered

QUARANTINE_DDL = "request_id long, pos int, error string, raw string"


def text_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines (`value`) of new files, with the file they are from and the place of their block in it."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def tail_logs(
    lines: DataFrame,
    config: Mapping[str, Any] | LogFormat,
    store: str,
    checkpoint: str,
    as_of: datetime,
    interval_minutes: float | None = None,
    period: str = "day",
) -> StreamingQuery:
    """Append the events of new log lines to the event table. The checkpoint is the
    cursor; a batch that runs again replaces what it wrote.

    Lines come from `text_stream` (whole files) or `tail.tail_stream` (what was
    added to them). `skip_until` drops the lines of a file before its first match,
    in whatever batch that comes: which files have had one is kept beside the
    checkpoint, a row per file of a batch.
    """
    fmt = config if isinstance(config, LogFormat) else LogFormat.parse(config)
    state = f"{checkpoint.rstrip('/')}-started"

    def ingest(batch: DataFrame, batch_id: int) -> None:
        rows, own = batch.withColumnRenamed("value", "line"), fmt
        if fmt.skip_until:
            if "pos" not in rows.columns:
                place = F.struct("block", F.monotonically_increasing_id().alias("nth"))
                rows = rows.withColumns({"pos": place, "was": F.lit(None).cast("string")})
            rows, own = started_lines(rows, fmt, state, batch_id)
        events = as_events(parse_lines(rows, own, as_of), F.lit(None))
        append_events(events, store, period, new_ids=True, owner=f"{checkpoint}#{batch_id}")

    writer = lines.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return triggered(writer, interval_minutes).start()


def push_stream(
    documents: DataFrame,
    store: str,
    quarantine: str,
    checkpoint: str,
    as_of: datetime,
    mode: str = "atomic",
    interval_minutes: float | None = None,
    period: str = "day",
) -> StreamingQuery:
    """Validate pushed documents (a `value` text column) into the event table and a
    quarantine. Every document is judged once per batch.

    A request is known by its place in its batch, so `request_id` is unique
    together with the `batch_id` of the quarantine.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        requests = batch.select(F.monotonically_increasing_id().alias("request_id"), F.col("value").alias("body"))
        judged = stored(outcomes(requests, as_of, mode), "judged")
        accepted = judged.where("error is null").orderBy("request_id", "pos")
        append_events(accepted_events(accepted), store, period, new_ids=True, owner=f"{checkpoint}#{batch_id}")
        land(judged.where("error is not null").select("request_id", "pos", "error", "raw"), quarantine, batch_id)

    writer = documents.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return triggered(writer, interval_minutes).start()


def landed_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return landed(spark, path, QUARANTINE_DDL)
