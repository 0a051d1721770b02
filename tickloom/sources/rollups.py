"""Kept partials of the event table, one folder of them for each folder of events.

`refresh` compares the folders of the table with the marks it kept of them
(files, bytes, newest change) and works out the partials of folders that are
new or have changed, by an append, a repeated batch, retention or merging.
Partials of folders that are gone are left out. Nothing else is read, so an
append costs what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.rollup import PARTIAL_DDL, partials
from tickloom.session import stored
from tickloom.sources.event_store import read_partitions
from tickloom.sources.folders import FOLDER_DDL, remove_folders
from tickloom.sources.merges import counted_folders
from tickloom.streaming.landing import BATCH, folders, hadoop_folder

KEEP = 2


@dataclass
class Rollup:
    """Partials (`name` and those of `operators.rollup`) and the events they are of."""

    kept: DataFrame
    events: DataFrame


def _marks(spark: SparkSession, rollup: str) -> tuple[int, DataFrame]:
    numbers = folders(spark, f"{rollup}/marks")[1]
    if not numbers:
        return -1, spark.createDataFrame([], FOLDER_DDL)
    return numbers[-1], spark.read.schema(FOLDER_DDL).parquet(f"{rollup}/marks/{BATCH}{numbers[-1]}")


def refresh(spark: SparkSession, store: str, rollup: str) -> int:
    """Bring the partials of a table up to date and return how many folders were worked out.

    Partials are written before the marks that tell of them, so a run cut short
    is repeated by the next one.
    """
    number, known = _marks(spark, rollup)
    now = stored(counted_folders(spark, store), "folders")
    same = ["path", "files", "bytes", "newest"]
    changed = stored(now.join(known.select(*same), same, "left_anti").select("path", "name_part", "period", "write"), "changed")
    n = changed.count()
    if n:
        rows = read_partitions(spark, store)
        wanted = changed.select(F.col("period").cast("date").alias("period"), "write").distinct()
        rows = rows.join(wanted, ["period", "write"], "left_semi")
        sums = partials(rows, ("name", "period", "write"))
        writer = sums.hint("rebalance", "name", "period", "write").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("name", "period", "write").parquet(f"{rollup}/partials")
    now.write.mode("overwrite").parquet(f"{rollup}/marks/{BATCH}{number + 1}")
    gone = known.join(now.select("path"), "path", "left_anti").select("path")
    remove_folders(spark, f"{rollup}/partials", (r.path for r in gone.toLocalIterator()))
    remove_folders(spark, f"{rollup}/marks", [f"{BATCH}{x}" for x in folders(spark, f"{rollup}/marks")[1][:-KEEP]])
    return n


def read_rollup(spark: SparkSession, store: str, rollup: str) -> Rollup:
    """The partials as of the last refresh."""
    place, fs = hadoop_folder(spark, f"{rollup}/partials")
    schema = f"{PARTIAL_DDL}, name string, period date, write long"
    kept = spark.read.schema(schema).parquet(f"{rollup}/partials") if fs.exists(place) else spark.createDataFrame([], schema)
    return Rollup(kept, read_partitions(spark, store))
