"""The event table on disk: Parquet partitioned by event name, period (day or month) and write.

Every append is a write of its own with a number nobody else has. The number is
part of the folder and, unless events bring their ids, the front of their ids:
ids grow from write to write and with the reading order within one. As a write
only touches its own folders, appends, retention and a repeated stream batch
never meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from tickloom.functions.buckets import days_before
from tickloom.model import EVENT_COLUMNS, EVENT_SCHEMA, Instant, normalize_events
from tickloom.operators.retention import RetentionRule, check_rules, retained, with_rule
from tickloom.operators.retrieve import since as rows_since
from tickloom.session import stored
from tickloom.sources import merges
from tickloom.sources.folders import hadoop_path as _folder, remove_folders, table_folders

RECORD_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
STORE_SCHEMA = StructType([*EVENT_SCHEMA.fields, StructField("period", DateType()), StructField("write", LongType())])
FOLDER = ("name", "period", "write")

# An id is the number of the write, the task within it and the row within the task.
WRITE_BITS, TASK_BITS, ROW_BITS = 22, 17, 24


def claim_write(spark: SparkSession, path: str, owner: str | None = None) -> int:
    """A number for one write to the table that no other write gets.

    A claim is an empty file under `_writes`, created only if it is not there.
    An `owner` (one batch of one stream) gets the number of its first claim
    again when it repeats itself.
    """
    claims, fs = _folder(spark, f"{path}/_writes")
    owned = None
    if owner is not None:
        owned, _ = _folder(spark, f"{path}/_writes/owners/{quote(owner, safe='')}")
        for status in fs.listStatus(owned) if fs.exists(owned) else ():
            return int(status.getPath().getName())
    fs.mkdirs(claims)
    names = [status.getPath().getName() for status in fs.listStatus(claims)]
    number = max((int(n) for n in names if n.isdigit()), default=0) + 1
    while True:
        if number >= 1 << WRITE_BITS:
            raise OverflowError(f"{path} has had {number} writes, more than ids can tell apart")
        claim, _ = _folder(spark, f"{path}/_writes/{number}")
        if fs.createNewFile(claim):
            break
        number += 1
    if owned is not None:
        mark, _ = _folder(spark, f"{path}/_writes/owners/{quote(owner, safe='')}/{number}")
        fs.createNewFile(mark)
    return number


def numbered(write: int) -> Column:
    """Ids for the rows of a write, in reading order. Too many tasks, or rows in
    one task, are an error and never a repeated id."""
    raw = F.monotonically_increasing_id()
    task, row = F.shiftright(raw, 33), raw.bitwiseAND((1 << 33) - 1)
    fits = (task < 1 << TASK_BITS) & (row < 1 << ROW_BITS)
    value = F.lit(write << (TASK_BITS + ROW_BITS)).bitwiseOR(F.shiftleft(task, ROW_BITS)).bitwiseOR(row)
    return F.when(fits, value).otherwise(F.raise_error(F.lit("too many tasks or rows per task in one write: repartition")).cast("long"))


def append_events(
    df: DataFrame, path: str, period: str = "day", new_ids: bool = False, owner: str | None = None
) -> int:
    """Add events to the table and return the number of the write.

    Nothing is replaced: equal events are kept twice, except that a write of the
    same `owner` replaces what it wrote before. `new_ids` gives the events ids
    of the table's own; otherwise they keep theirs. `period="month"` suits names
    with few events a day. The rebalance hint gathers each folder into few files
    and splits one that is much larger than the rest over several tasks.
    """
    if period not in ("day", "month"):
        raise ValueError(f"unknown period {period!r}")
    spark = df.sparkSession
    write = claim_write(spark, path, owner)
    if owner is not None and merges.was_merged(spark, path, write):
        return write
    if new_ids:
        df = df.withColumn("event_id", numbered(write))
    start = F.date_trunc(period, "timestamp").cast("date")
    rows = df.select(*EVENT_COLUMNS, start.alias("period"), F.lit(write).cast("long").alias("write"))
    replace_folders(rows, path)
    if owner is not None and merges.was_merged(spark, path, write):  # while this wrote it again
        again = table_folders(spark, path).where(F.col("write") == write).select("path")
        remove_folders(spark, path, (r.path for r in again.toLocalIterator()))
    merges.finished(spark, path, write)
    return write


def replace_folders(rows: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Write the folders that the rows belong to, and no others; files may be sorted."""
    rows = rows.hint("rebalance", *FOLDER)
    if order:
        rows = rows.sortWithinPartitions(*FOLDER, *order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDER).parquet(path)


def append_event(
    spark: SparkSession,
    path: str,
    name: str,
    as_of: datetime,
    value: float = 0,
    tag: str | None = None,
    additional_info: str | None = None,
    timestamp: datetime | None = None,
) -> None:
    """Add one event."""
    if not name:
        raise ValueError("an event needs a name")
    row = spark.range(1, numPartitions=1).select(
        F.lit(name).alias("name"),
        F.lit(float(value)).alias("value"),
        F.lit(tag).cast("string").alias("tag"),
        F.lit(additional_info).cast("string").alias("additional_info"),
    )
    fields = {c: c for c in row.columns}
    append_events(normalize_events(row, fields, timestamp or as_of), path, new_ids=True)


def read_events(
    spark: SparkSession, path: str, since: Instant | None = None, keep_period: bool = False
) -> DataFrame:
    """The event frame of a table; filters on `name` prune its folders.

    `since` leaves out older events, and with them the folders of earlier
    periods. With `keep_period` the frame keeps its `period`, by which lookups
    and views that name an age or a time range prune folders as well.
    """
    rows = read_partitions(spark, path)
    if since is not None:
        rows = rows_since(rows, since)
    return rows.select(*EVENT_COLUMNS, *(["period"] if keep_period else []))


def read_partitions(spark: SparkSession, path: str, below: Sequence[str] | None = None) -> DataFrame:
    """Events with the first day and the write of the folder they lie in, of the
    whole table or of the folders given by their paths below it."""
    if below is not None:
        return spark.read.schema(STORE_SCHEMA).option("basePath", path).parquet(*[f"{path}/{p}" for p in below])
    return merges.counted(spark.read.schema(STORE_SCHEMA).parquet(path), path)


def export_records(df: DataFrame, path: str) -> None:
    """Write any result as JSON records, one per line."""
    df.write.mode("overwrite").option("timestampFormat", RECORD_TIME).json(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", RECORD_TIME).json(path)


def copy_retained(
    spark: SparkSession,
    path: str,
    target: str,
    rules: Sequence[RetentionRule],
    as_of: datetime,
    period: str = "day",
) -> None:
    """Write the events that survive the rules to a new table.

    The old table stays as it was until the caller switches over, so a job lost
    half-way leaves nothing broken.
    """
    append_events(retained(read_events(spark, path), rules, as_of), target, period)


def apply_retention(
    spark: SparkSession, path: str, rules: Sequence[RetentionRule], as_of: datetime
) -> dict[int, int]:
    """Remove expired events in place and return the deleted count per rule index.

    Only folders of the rules' event names that begin before the latest cutoff
    are read, and of those only folders that hold expired events are replaced.
    Which these are is decided once and kept as a table. An append that happens
    meanwhile has folders of its own and is left alone. A folder without any
    events left is removed. A run cut short can simply be repeated.
    """
    check_rules(rules)
    if not rules:
        return {}
    counts = dict.fromkeys(range(len(rules)), 0)
    while True:
        before = merges.merges_so_far(spark, path)
        for rule, n in _remove_expired(spark, path, rules, as_of).items():
            counts[rule] += n
        # What was merged while this ran may hold events it has not seen.
        if merges.merges_so_far(spark, path) == before:
            return counts


def _remove_expired(spark: SparkSession, path: str, rules: Sequence[RetentionRule], as_of: datetime) -> dict[int, int]:
    latest = days_before(as_of, min(r.max_age_days for r in rules)).date() + timedelta(days=1)
    reached = read_partitions(spark, path).where(F.col("name").isin(sorted({r.event_name for r in rules})))
    touched = with_rule(reached.where(F.col("period") <= F.lit(latest)), rules, as_of)
    expired = F.col("_rule").isNotNull()
    folders = touched.groupBy(*FOLDER).agg(F.count_if(expired).alias("gone"), F.count_if(~expired).alias("left"))
    folders = stored(folders.where("gone > 0"), "expired")
    # One row per rule.
    counts = {r["_rule"]: r["n"] for r in touched.where(expired).groupBy("_rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    mixed = folders.where(F.col("left") > 0).select(*FOLDER)
    replace_folders(touched.where(~expired).drop("_rule").join(mixed, list(FOLDER), "left_semi"), path)
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    empty = folders.where(F.col("left") == 0).toLocalIterator()
    remove_folders(spark, path, (f"name={escape(r['name'])}/period={r['period']}/write={r['write']}" for r in empty))
    return counts
