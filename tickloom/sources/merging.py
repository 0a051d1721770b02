"""Merging the folders of many small writes.

A stream of small batches leaves a folder per name, period and batch. `merge_writes`
gathers the writes of one (name, period) into one folder of files sorted by time,
under a write number of its own. Events keep their ids.

Readers see either what was there or what takes its place:

1. The merged rows are written under a new number whose `_merges/<number>.open`
   says that it does not count yet.
2. `_merges/<number>.done` lists the folders it replaces. It comes into place by
   one rename; from then on the merged rows count and the listed folders do not.
3. The replaced folders are removed, and with them the two marks.

A run that is cut short leaves an open number, whose rows the next run removes, or
a done one, which the next run clears up; nothing is lost or counted twice.

What happens meanwhile: an append has a number of its own and is not listed. A
folder that retention or a repeated batch has changed since it was listed is told
by its files, and its (name, period) is left as it was. Retention that ends while
a merge counts for the first time runs again over it; expired events that a merge
still under way has read go with the next retention. A repeated batch whose write
was merged writes nothing. Only writes that were finished are merged. There is one
merge of a table at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.model import EVENT_COLUMNS
from tickloom.session import stored
from tickloom.sources.event_store import claim_write, read_partitions, replace_folders
from tickloom.sources.folders import hadoop_path, remove_folders, table_folders
from tickloom.sources.merges import DONE, FINISHED, MERGES, OPEN, clear, finished, names_below

# Folders one merge takes; what is left is the next one's.
FOLDERS_A_MERGE = 10_000
GROUP = ["name_part", "period"]


def _finished_writes(spark: SparkSession, path: str) -> DataFrame:
    numbers = [(int(n),) for n in names_below(spark, f"{path}/{FINISHED}") if n.isdigit()]
    return spark.createDataFrame(numbers, "write long")


def merge_writes(spark: SparkSession, path: str, at_least: int = 8) -> list[int]:
    """Merge the folders of every (name, period) that has `at_least` of finished
    writes, and return the numbers of the merged writes."""
    clear(spark, path)
    folders = stored(table_folders(spark, path).join(_finished_writes(spark, path), "write", "left_semi"), "folders")
    many = folders.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, at_least)).select(*GROUP)
    chosen = stored(folders.join(many, GROUP, "left_semi"), "merged-folders")
    rounds = -(-chosen.count() // FOLDERS_A_MERGE)
    made = []
    for i in range(rounds):
        own = chosen.where(F.pmod(F.xxhash64(*GROUP), F.lit(rounds)) == i)
        if own.limit(1).count():
            made.append(_merge(spark, path, own))
    return made


def _merge(spark: SparkSession, path: str, chosen: DataFrame) -> int:
    number = claim_write(spark, path)
    place = lambda name: hadoop_path(spark, f"{path}/{MERGES}/{name}")[0]
    fs = hadoop_path(spark, path)[1]
    fs.mkdirs(hadoop_path(spark, f"{path}/{MERGES}")[0])
    fs.createNewFile(place(f"{number}{OPEN}"))
    rows = read_partitions(spark, path, below=[r.path for r in chosen.select("path").collect()])
    rows = rows.select(*EVENT_COLUMNS, "period", F.lit(number).cast("long").alias("write"))
    replace_folders(rows, path, order=["timestamp", "event_id"])
    # What has changed since it was listed stays as it is.
    now = table_folders(spark, path)
    changed = stored(chosen.join(now, ["path", "files", "bytes", "newest"], "left_anti").select(*GROUP).distinct(), "changed-folders")
    undone = changed.select(F.concat_ws("/", "name_part", F.concat(F.lit("period="), "period"), F.lit(f"write={number}")).alias("path"))
    remove_folders(spark, path, (r.path for r in undone.toLocalIterator()))
    chosen.join(changed, GROUP, "left_anti").select(*chosen.columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MERGES}/.{number}")
    fs.rename(place(f".{number}"), place(f"{number}{DONE}"))
    finished(spark, path, number)
    clear(spark, path)
    return number
