"""The folders of the event table: what is in them, and safe changes to them.

The table has a folder for each (name, period, write). Listing them reads no
events; it is a distributed listing of files.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

REMOVERS = 16
FOLDER_DDL = "path string, name_part string, period string, write long, files long, bytes long, newest timestamp"


def hadoop_path(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_folders(spark: SparkSession, path: str) -> DataFrame:
    """One row per folder: its path below the table, the parts of it, and a mark of what it holds."""
    pattern = r"(name=[^/]*)/period=([^/]*)/write=(\d+)/[^/]+$"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FOLDER_DDL)
    part = lambda i: F.regexp_extract("path", pattern, i)
    rows = files.select(part(1).alias("name_part"), part(2).alias("period"), part(3).alias("write"), "length", "modificationTime")
    rows = rows.where("name_part <> ''").groupBy("name_part", "period", F.col("write").cast("long").alias("write")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest")
    )
    return rows.select(F.concat_ws("/", "name_part", F.concat(F.lit("period="), "period"), F.concat(F.lit("write="), "write")).alias("path"), "*")


def remove_folders(spark: SparkSession, path: str, below: Iterable[str]) -> None:
    """Remove folders, several at a time; the list is worked off as it comes."""

    def remove(part: str) -> None:
        folder, fs = hadoop_path(spark, f"{path}/{part}")
        fs.delete(folder, True)

    with ThreadPoolExecutor(REMOVERS) as pool:
        batch: list[str] = []
        for part in below:
            batch.append(part)
            if len(batch) == 64 * REMOVERS:
                list(pool.map(remove, batch))
                batch = []
        list(pool.map(remove, batch))
