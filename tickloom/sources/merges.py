"""Which writes of the event table count while small ones are merged (see `merging`)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.sources.folders import FOLDER_DDL, hadoop_path, remove_folders, table_folders

MERGES = "_merges"
FINISHED = "_writes/finished"
MERGED = "_writes/merged"
MERGE_NUMBERS = "_writes/merges"
OPEN, DONE = ".open", ".done"


@dataclass(frozen=True)
class Marks:
    """Merges that are open (their rows do not count), and done but not cleared up."""

    open: tuple[int, ...] = ()
    done: tuple[int, ...] = ()


def names_below(spark: SparkSession, path: str) -> list[str]:
    folder, fs = hadoop_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def marks(spark: SparkSession, path: str) -> Marks:
    names = names_below(spark, f"{path}/{MERGES}")
    numbers = lambda ending: {int(n.removesuffix(ending)) for n in names if n.endswith(ending)}
    done = numbers(DONE)
    return Marks(tuple(sorted(numbers(OPEN) - done)), tuple(sorted(done)))


def replaced(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The folders a done merge takes the place of."""
    return spark.read.schema(FOLDER_DDL).parquet(f"{path}/{MERGES}/{number}{DONE}")


def counted(rows: DataFrame, path: str) -> DataFrame:
    """Rows of the table (with `period` and `write`) that count, if merges are under way."""
    spark = rows.sparkSession
    now = marks(spark, path)
    if now.open:
        rows = rows.where(~F.col("write").isin(list(now.open)))
    for number in now.done:
        gone = replaced(spark, path, number).select(
            F.url_decode(F.regexp_replace(F.regexp_replace("name_part", "^name=", ""), r"\+", "%2B")).alias("name"),
            F.col("period").cast("date").alias("period"),
            "write",
        )
        rows = rows.join(gone, ["name", "period", "write"], "left_anti").select(*rows.columns)
    return rows


def counted_folders(spark: SparkSession, path: str) -> DataFrame:
    """The folders of the table whose rows count."""
    now = marks(spark, path)
    rows = table_folders(spark, path)
    if now.open:
        rows = rows.where(~F.col("write").isin(list(now.open)))
    for number in now.done:
        rows = rows.join(replaced(spark, path, number).select("path"), "path", "left_anti").select(*rows.columns)
    return rows


def merges_so_far(spark: SparkSession, path: str) -> list[str]:
    """The numbers of all merges that ever counted."""
    return sorted(names_below(spark, f"{path}/{MERGE_NUMBERS}"))


def finished(spark: SparkSession, path: str, write: int) -> None:
    """Say that a write is whole, so that it may be merged."""
    mark, fs = hadoop_path(spark, f"{path}/{FINISHED}/{write}")
    fs.createNewFile(mark)


def was_merged(spark: SparkSession, path: str, write: int) -> bool:
    """Whether rows of a write already count as part of a merged one."""
    mark, fs = hadoop_path(spark, f"{path}/{MERGED}/{write}")
    return fs.exists(mark)


def clear(spark: SparkSession, path: str) -> None:
    """Finish merges that are done, and undo those that never were."""
    now = marks(spark, path)
    fs = hadoop_path(spark, path)[1]
    drop = lambda name: fs.delete(hadoop_path(spark, f"{path}/{MERGES}/{name}")[0], True)
    for number in now.done:
        old = replaced(spark, path, number)
        finished(spark, path, number)
        fs.createNewFile(hadoop_path(spark, f"{path}/{MERGE_NUMBERS}/{number}")[0])
        # Marks of merged writes first: a batch that repeats one must not write it anew.
        for row in old.select("write").distinct().toLocalIterator():
            fs.createNewFile(hadoop_path(spark, f"{path}/{MERGED}/{row.write}")[0])
        remove_folders(spark, path, (r.path for r in old.select("path").toLocalIterator()))
        drop(f"{number}{OPEN}")
        drop(f"{number}{DONE}")
    for number in now.open:
        folders = table_folders(spark, path).where(F.col("write") == number).select("path")
        remove_folders(spark, path, (r.path for r in folders.toLocalIterator()))
        drop(f"{number}{OPEN}")
    for name in names_below(spark, f"{path}/{MERGES}"):
        if name.startswith("."):
            drop(name)
