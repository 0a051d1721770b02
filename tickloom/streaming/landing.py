"""Where streams put their output: one folder per micro-batch.

A batch that runs again after a failure overwrites its own folder, so every
row lands exactly once. Batches that are done can be merged into one folder,
which takes their place when it is complete; readers then open that folder and
the batches behind it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

BATCH, MERGED = "batch=", "merged="


def hadoop_folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def land(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of a batch, in files of even size, with the number of the batch."""
    rows = df.withColumn("batch_id", F.lit(batch_id).cast("long")).hint("rebalance")
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}{batch_id}")


def folders(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The last merged batch, if there is one, and the batches behind it."""
    folder, fs = hadoop_folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = lambda prefix: sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))
    merged = (numbers(MERGED) or [None])[-1]
    return merged, [n for n in numbers(BATCH) if merged is None or n > merged]


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What has landed; every row has the `batch_id` it came with."""
    merged, batches = folders(spark, path)
    paths = ([] if merged is None else [f"{path}/{MERGED}{merged}"]) + [f"{path}/{BATCH}{n}" for n in batches]
    schema = f"{schema}, batch_id long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], keep: int = 2) -> None:
    """Merge all batches but the last `keep`, which a stream may still repeat.

    `merge` turns landed rows into fewer with the same meaning. The merged rows
    are written aside and renamed into place; what they replace is removed
    afterwards, so a run cut short changes nothing that readers see.
    """
    merged, batches = folders(spark, path)
    if len(batches) <= keep:
        return
    upto = batches[-keep - 1] if keep else batches[-1]
    rows = landed(spark, path, schema).where(F.col("batch_id") <= upto)
    aside = f"{path}/_merging-{uuid.uuid4().hex}"
    merge(rows).hint("rebalance").write.parquet(aside)
    source, fs = hadoop_folder(spark, aside)
    fs.rename(source, hadoop_folder(spark, f"{path}/{MERGED}{upto}")[0])
    for name in [f"{BATCH}{n}" for n in batches if n <= upto] + ([] if merged is None else [f"{MERGED}{merged}"]):
        fs.delete(hadoop_folder(spark, f"{path}/{name}")[0], True)


def newest_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last landed state of every key."""
    values = [c for c in df.columns if c not in (*keys, "batch_id")]
    last = F.max("batch_id").alias("batch_id")
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values], last)


def triggered(writer: DataStreamWriter, interval_minutes: float | None) -> DataStreamWriter:
    """Run every so often, or work off what is there and stop (None)."""
    if interval_minutes is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{int(interval_minutes * 60)} seconds")
