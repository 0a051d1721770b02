"""Pluggable sources: a function that yields events, its retention rules and its cursor."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tickloom.model import gate_named, micros
from tickloom.operators.retention import RetentionRule
from tickloom.operators.stats import RUN_LOG_SCHEMA
from tickloom.sources.event_store import append_events, apply_retention
from tickloom.sources.logs import DEFAULT_EVENT_NAME, LogFormat, as_events, parse_lines, read_log_events
from tickloom.sources.tail import read_added, read_offsets, started_lines, write_offsets


@dataclass
class Increment:
    """Events that are new since a place the collector keeps itself. `owner` names
    the increment, so one that is collected again replaces what it wrote; `commit`
    moves the place and is called once the events are in the table."""

    events: DataFrame
    owner: str
    commit: Callable[[], None]


Collect = Callable[[SparkSession, Mapping[str, Any], datetime | None], DataFrame | Increment]


Retention = Callable[[Mapping[str, Any]], Sequence[Mapping[str, Any]]]

# Collect functions and retention rules by module name, for configs that name them.
REGISTRY: dict[str, tuple[Collect, Retention | None]] = {}


def register(module: str, collect: Collect, retention: Retention | None = None) -> None:
    REGISTRY[module] = (collect, retention)


@dataclass
class Collector:
    """`collect(spark, config, cursor)` returns an event frame newer than the cursor."""

    module: str
    collect: Collect
    config: Mapping[str, Any] = field(default_factory=dict)
    unique_id: str = ""
    retention: Retention | None = None
    interval_minutes: float | None = None
    at_start: bool = False

    @classmethod
    def parse(cls, config: Mapping[str, Any]) -> Collector:
        """A collector from its config entry; the module must be registered."""
        module = config.get("module")
        if module not in REGISTRY:
            raise ValueError(f"unknown collector module {module!r}, registered: {sorted(REGISTRY)}")
        collect, retention = REGISTRY[module]
        return cls(
            module,
            collect,
            config.get("config") or {},
            config.get("unique_id") or "",
            retention,
            config.get("collect_interval_in_minutes"),
            bool(config.get("collect_when_server_starts", False)),
        )

    def due(self, now: datetime, last: datetime | None, started: datetime | None = None) -> bool:
        """Whether its interval has passed since the last run, or since the schedule
        started if it never ran. Without an interval it always is, and before the
        first run also when it is to collect at the start."""
        since = last or started
        if not self.interval_minutes or since is None or (last is None and self.at_start):
            return True
        return micros(now) - micros(since) >= self.interval_minutes * 60_000_000

    @property
    def key(self) -> str:
        return f"{self.module}_{self.unique_id}"

    def retention_rules(self) -> list[RetentionRule]:
        return [RetentionRule.parse(r) for r in (self.retention(self.config) if self.retention else ())]


def read_cursor(spark: SparkSession, path: str, key: str) -> datetime | None:
    """The saved cursor of a collector; cursors are appended, the newest counts."""
    try:
        saved = spark.read.schema("key string, last_timestamp timestamp").parquet(path)
        row = saved.where(F.col("key") == key).agg(F.max(F.unix_micros("last_timestamp"))).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row[0] is None else datetime.fromtimestamp(row[0] // 1_000_000).astimezone().replace(
        microsecond=row[0] % 1_000_000
    )


def _observed(watch: Observation) -> dict[str, Any]:
    """Metrics of a finished write; Spark keeps none for a frame it plans away as empty."""
    try:
        return watch.get
    except Py4JError:
        return {}


def last_runs(spark: SparkSession, run_log: str) -> dict[str, datetime]:
    """When each collector ran last, by key; one row per collector."""
    try:
        log = spark.read.schema(RUN_LOG_SCHEMA).parquet(run_log)
        newest = log.groupBy("module", "unique_id").agg(F.max(F.unix_micros("started")).alias("us")).collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    return {f"{r.module}_{r.unique_id}": zero + timedelta(microseconds=r.us) for r in newest if r.us is not None}


def _fault_of_source(spark: SparkSession, failure: Exception) -> bool:
    """Whether other collectors can go on: not without memory or a session."""
    text = str(failure)
    lost = isinstance(failure, (MemoryError, Py4JNetworkError)) or "OutOfMemoryError" in text
    return not lost and not spark.sparkContext._jsc.sc().isStopped()


def run_collectors(
    spark: SparkSession,
    collectors: Sequence[Collector],
    store: str,
    cursors: str,
    run_log: str,
    as_of: datetime,
    started: datetime | None = None,
) -> None:
    """Run every collector that is due once: append its events, then move its cursor.

    Events get ids of the event table's own. Records without a name are left out
    and counted. A collector that fails keeps its cursor and is recorded in the
    run log; the others still run, unless memory or the session is lost. The
    cursor moves only after the append, so nothing is lost on a failure.
    `started` is when the schedule began, for collectors that never ran.
    """
    rows = []
    last = last_runs(spark, run_log) if any(c.interval_minutes for c in collectors) else {}
    for c in collectors:
        if not c.due(as_of, last.get(c.key), started):
            continue
        began, error, seen = time.monotonic(), None, {}
        try:
            collected, owner, commit = c.collect(spark, c.config, read_cursor(spark, cursors, c.key)), None, None
            if isinstance(collected, Increment):
                collected, owner, commit = collected.events, f"{c.key}#{collected.owner}", collected.commit
            watch, nameless = Observation(), F.coalesce(F.col("name") == "", F.lit(True))
            collected = collected.observe(
                watch,
                F.count_if(~nameless).alias("n"),
                F.count_if(nameless).alias("rejected"),
                F.max(F.unix_micros("timestamp")).alias("newest"),
            )
            append_events(gate_named(collected)[0], store, new_ids=True, owner=owner)
            seen = _observed(watch)
            if commit is not None:
                commit()
            if seen.get("newest") is not None:
                moved = spark.range(1, numPartitions=1).select(
                    F.lit(c.key).alias("key"), F.timestamp_micros(F.lit(seen["newest"])).alias("last_timestamp")
                )
                moved.write.mode("append").parquet(cursors)
        except Exception as failure:  # one bad collector must not stop the rest
            if not _fault_of_source(spark, failure):
                raise
            error = f"{type(failure).__name__}: {failure}"
        took = (time.monotonic() - began) * 1000
        rows.append((c.module, c.unique_id, took, seen.get("n") or 0, seen.get("rejected") or 0, error))
    if rows:
        _log(spark, run_log, [(*row, as_of, 0, 0) for row in rows])


def run_retention(
    spark: SparkSession, collectors: Sequence[Collector], store: str, run_log: str, as_of: datetime
) -> dict[str, int]:
    """Apply the rules of all collectors in one pass and log what each deleted.

    All rules are checked before anything is removed. An event counts for the
    first rule that hits it, in collector order.
    """
    owned = [(c, rule) for c in collectors for rule in c.retention_rules()]
    counts = apply_retention(spark, store, [rule for _, rule in owned], as_of)
    deleted = {c.key: 0 for c in collectors}
    for i, (c, _) in enumerate(owned):
        deleted[c.key] += counts[i]
    _log(spark, run_log, [(c.module, c.unique_id, None, None, None, None, None, 1, deleted[c.key]) for c in collectors])
    return deleted


def _log(spark: SparkSession, run_log: str, rows: Sequence[tuple[Any, ...]]) -> None:
    """Append run or clean-up rows; a moment is kept as microseconds until it is written."""
    columns = "module string, unique_id string, duration_ms double, n_events long, rejected long, error string"
    packed = [(*r[:6], None if r[6] is None else micros(r[6]), *r[7:]) for r in rows]
    log = spark.createDataFrame(packed, f"{columns}, started long, cleanups long, deleted long")
    log = log.withColumn("started", F.timestamp_micros("started"))
    order = [part.split()[0] for part in RUN_LOG_SCHEMA.split(", ")]
    log.select(*order).write.mode("append").parquet(run_log)


def collect_logs(spark: SparkSession, config: Mapping[str, Any], cursor: datetime | None) -> DataFrame:
    """Events of the log files at `log_file_path` that are newer than the cursor.

    `as_of` in the config gives the year of formats that carry none.
    """
    if not config.get("log_file_path"):
        raise ValueError("log_file_path not specified in collector configuration")
    as_of = config.get("as_of") or datetime.now()
    return read_log_events(spark, config["log_file_path"], LogFormat.parse(config), as_of, cursor)


def collect_log_tail(spark: SparkSession, config: Mapping[str, Any], cursor: datetime | None) -> Increment:
    """Events of what was added to the log files at `log_file_path` since the offsets
    kept at `offsets_path`, wherever the cursor is; no file is read twice."""
    for required in ("log_file_path", "offsets_path"):
        if not config.get(required):
            raise ValueError(f"{required} not specified in collector configuration")
    fmt, offsets = LogFormat.parse(config), config["offsets_path"]
    number, since = read_offsets(spark, f"{offsets}/read")
    lines, until = read_added(spark, config["log_file_path"], since)
    if fmt.skip_until:
        lines, fmt = started_lines(lines, fmt, f"{offsets}/started", number + 1)
    events = as_events(parse_lines(lines, fmt, config.get("as_of") or datetime.now()), F.lit(None))
    return Increment(events, f"{offsets}#{number + 1}", lambda: write_offsets(spark, f"{offsets}/read", number + 1, until))


def log_retention(config: Mapping[str, Any]) -> list[dict[str, Any]]:
    """The age named by `retention_days`; without one nothing is ever deleted."""
    name = config.get("event_name") or DEFAULT_EVENT_NAME
    days = config.get("retention_days")
    return [] if days is None else [{"event_name": name, "max_age_days": days}]


register("logs_collector", collect_logs, log_retention)
register("logs_tail_collector", collect_log_tail, log_retention)
