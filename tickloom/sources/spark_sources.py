"""Collectors as data sources of Spark, for `spark.read` and `spark.readStream`.

A partitioned collector says how far its origin reaches (`latest`), cuts what
lies between two such offsets into partitions, and reads one partition. Nothing
else is needed: the same three methods serve a batch read from a start to now
and a stream whose batches lie between offsets that Spark writes into its
checkpoint. Partitions are read by as many tasks, and a batch that failed is
planned again from the offsets it was logged with, so `partitions` may depend
on nothing but its arguments.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tickloom.session import ship_package


class PartitionedCollector(ABC):
    """An origin of rows whose progress is a JSON object. Made from the options of the read."""

    schema: str

    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)

    def start(self) -> dict[str, Any]:
        """The offset in front of everything."""
        return {}

    @abstractmethod
    def latest(self) -> dict[str, Any]:
        """How far the origin reaches now."""

    @abstractmethod
    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[dict[str, Any]]:
        """What lies between two offsets, in pieces that can be read apart."""

    @abstractmethod
    def read(self, part: dict[str, Any]) -> Iterator[pa.RecordBatch]:
        """The rows of one piece."""

    def done(self, end: dict[str, Any]) -> None:
        """Called when a stream needs nothing up to `end` any more."""


class Piece(InputPartition):
    def __init__(self, part: dict[str, Any]):
        super().__init__(part)


class CollectorReader(DataSourceReader):
    """From the option `since` (an offset, else the start) to the option `until` (else now)."""

    def __init__(self, collector: PartitionedCollector):
        self.collector = collector

    def partitions(self) -> list[Piece]:
        given = {k.lower(): v for k, v in self.collector.options.items()}
        since = json.loads(given["since"]) if "since" in given else self.collector.start()
        until = json.loads(given["until"]) if "until" in given else self.collector.latest()
        # Without a partition of its own Spark would ask for rows of no partition.
        return [Piece(x) for x in self.collector.partitions(since, until)] or [Piece({})]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value:
            yield from self.collector.read(partition.value)


class CollectorStream(DataSourceStreamReader):
    def __init__(self, collector: PartitionedCollector):
        self.collector = collector

    def initialOffset(self) -> dict:
        return self.collector.start()

    def latestOffset(self) -> dict:
        return self.collector.latest()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(x) for x in self.collector.partitions(start, end)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.collector.read(partition.value)

    def commit(self, end: dict) -> None:
        self.collector.done(end)


def register_source(spark: SparkSession, name: str, collector: type[PartitionedCollector]) -> None:
    """Make a collector known as a format: `spark.read.format(name)`, `spark.readStream.format(name)`."""
    ship_package(spark)

    # Made here, so it goes to the workers together with the collector it names.
    class CollectorSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return collector.schema

        def reader(self, schema: Any) -> DataSourceReader:
            return CollectorReader(collector(self.options))

        def streamReader(self, schema: Any) -> DataSourceStreamReader:
            return CollectorStream(collector(self.options))

    spark.dataSource.register(CollectorSource)
