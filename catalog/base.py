"""Registry, test-table adapters and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from tickloom.model import normalize_events
from tickloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

APP_NOW = datetime(2024, 1, 31)
ORDER_NOW = datetime(2001, 8, 2)
SHIP_NOW = datetime(2001, 11, 5)

# Columns the test tables always fill.
FILLED = ("value", "timestamp")

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
ORDERS = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
LINEITEM = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query, with its SQL where there is one."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return plain(build(spark, sf_dir))

        QUERIES[build.__name__] = run
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as the zone-less ones the tables hold."""
    zoned = {f.name for f in df.schema if isinstance(f.dataType, TimestampType)}
    if not zoned:
        return df
    quoted = {c: F.col(f"`{c}`") for c in df.columns}
    return df.select(*[quoted[c].cast("timestamp_ntz").alias(c) if c in zoned else quoted[c] for c in df.columns])


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def app_columns(df: DataFrame) -> DataFrame:
    fields = {"event_id": "event_id", "name": F.lit("app_event"), "value": "value"}
    fields |= {"tag": "event_type", "additional_info": "props", "timestamp": "ts"}
    return normalize_events(df, fields, APP_NOW, complete=FILLED)


def user_columns(df: DataFrame) -> DataFrame:
    fields = {
        "event_id": "event_id",
        "name": F.concat(F.lit("user_"), F.col("event_type")),
        "value": "value",
        "tag": (F.col("user_id") % 10).cast("string"),
        "additional_info": F.col("user_id").cast("string"),
        "timestamp": "ts",
    }
    return normalize_events(df, fields, APP_NOW, complete=FILLED)


def app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app_columns(raw_events(spark, sf_dir))


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_columns(raw_events(spark, sf_dir))


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"event_id": "o_orderkey", "name": F.lit("order"), "value": "o_totalprice"}
    fields |= {"tag": "o_orderstatus", "additional_info": "o_orderpriority", "timestamp": "o_orderdate"}
    return normalize_events(spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet"), fields, ORDER_NOW, complete=FILLED)


def ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"event_id": "l_orderkey", "name": F.lit("shipment"), "value": "l_quantity"}
    fields |= {"tag": "l_returnflag", "additional_info": "l_linestatus", "timestamp": "l_shipdate"}
    return normalize_events(spark.read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet"), fields, SHIP_NOW, complete=FILLED)


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All adapters together: names of very different sizes."""
    frame = app(spark, sf_dir)
    for part in (user, order, ship):
        frame = frame.unionByName(part(spark, sf_dir))
    return frame


APP = """(SELECT event_id, 'app_event' AS name, value, event_type AS tag, props AS additional_info,
    ts AS "timestamp" FROM events)"""
USER = """(SELECT event_id, 'user_' || event_type AS name, value, CAST(user_id % 10 AS VARCHAR) AS tag,
    CAST(user_id AS VARCHAR) AS additional_info, ts AS "timestamp" FROM events)"""
ORDER = """(SELECT o_orderkey AS event_id, 'order' AS name, o_totalprice AS value, o_orderstatus AS tag,
    o_orderpriority AS additional_info, o_orderdate AS "timestamp" FROM orders)"""
SHIP = """(SELECT l_orderkey AS event_id, 'shipment' AS name, l_quantity AS value, l_returnflag AS tag,
    l_linestatus AS additional_info, l_shipdate AS "timestamp" FROM lineitem)"""
EVERYTHING = f"(SELECT * FROM {APP} UNION ALL SELECT * FROM {USER} UNION ALL SELECT * FROM {ORDER} UNION ALL SELECT * FROM {SHIP})"

TIME_TEXT = """strftime("timestamp", '%Y-%m-%d %H:%M:%S') ||
    CASE WHEN epoch_us("timestamp") % 1000000 = 0 THEN '' ELSE strftime("timestamp", '.%f') END"""


def mean_sql(mean: str, digits: int = 4) -> str:
    """A mean rounded half away from zero, after clearing its summation noise."""
    return f"CAST(CAST(CAST({mean} AS DECIMAL(30,{digits + 5})) AS DECIMAL(30,{digits})) AS DOUBLE)"


def whole_mean_sql(mean: str) -> str:
    return f"floor(CAST(CAST({mean} AS DECIMAL(30,9)) AS DOUBLE) + 0.5)"


def bucket_sql(interval: str, ts: str = '"timestamp"') -> str:
    minutes = {"10m": 10, "30m": 30}
    if interval in minutes:
        return f"time_bucket(INTERVAL '{minutes[interval]} minutes', {ts})"
    return f"CAST(date_trunc('{interval}', {ts}) AS TIMESTAMP)"
