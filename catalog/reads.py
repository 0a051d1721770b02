"""Retrieval and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from catalog.base import (
    APP,
    APP_NOW,
    EVERYTHING,
    ORDER,
    ORDER_NOW,
    USER,
    app,
    everything,
    order,
    query,
    raw_events,
    user,
)
from tickloom.model import gate_named, normalize_events
from tickloom.operators import retrieve
from tickloom.plans.specs import SourceSpec
from tickloom.session import fresh_dir
from tickloom.sources import event_store


@query(f"""SELECT * FROM {USER} WHERE name = 'user_error' AND tag IN ('1', '3', '7')
    ORDER BY "timestamp", event_id""")
def events_by_name_tags(spark, sf):
    return retrieve.get_events(user(spark, sf), "user_error", ["1", "3", "7"])


@query(f"""SELECT * FROM {APP} WHERE name = 'app_event' AND tag = 'purchase' ORDER BY "timestamp", event_id""")
def events_by_single_tag(spark, sf):
    return retrieve.get_events(app(spark, sf), "app_event", "purchase")


@query(f"""SELECT * FROM {ORDER} WHERE name = 'order' AND "timestamp" >= TIMESTAMP '2000-08-02 00:00:00'
    ORDER BY "timestamp", event_id""")
def events_max_age(spark, sf):
    return retrieve.get_events(order(spark, sf), "order", [], max_age_days=365, as_of=ORDER_NOW)


@query(f"""SELECT * FROM {ORDER} WHERE tag IN ('F', 'O') ORDER BY "timestamp" DESC, event_id DESC LIMIT 1500""")
def events_latest_n(spark, sf):
    return retrieve.get_events(order(spark, sf), "order", ["F", "O"], max_results=1500)


@query(f"""SELECT event_id, name, value, tag, additional_info, "timestamp" FROM
    (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY "timestamp" DESC, event_id DESC) AS place
     FROM {USER} WHERE name = 'user_click') WHERE place = 1""")
def latest_by_tag(spark, sf):
    return retrieve.latest_by_tag(user(spark, sf), "user_click", ties="one")


@query(f"""SELECT e.* FROM {ORDER} e JOIN (SELECT tag, max("timestamp") AS newest FROM {ORDER} GROUP BY tag) m
    ON e.tag = m.tag AND e."timestamp" = m.newest""")
def latest_by_tag_ties(spark, sf):
    return retrieve.latest_by_tag(order(spark, sf), "order")


@query(f"""SELECT e.* FROM {ORDER} e JOIN (SELECT tag, max("timestamp") AS newest FROM {ORDER} GROUP BY tag) m
    ON e.tag = m.tag AND e."timestamp" = m.newest WHERE e.tag IN ('O', 'P')""")
def latest_by_listed_tags(spark, sf):
    return retrieve.latest_by_tag(order(spark, sf), "order", ["O", "P"])


@query(f"""SELECT e.* FROM (SELECT event_id, name, value, CASE WHEN event_id % 13 = 0 THEN NULL ELSE tag END AS tag,
    additional_info, "timestamp" FROM {APP}) e JOIN (SELECT event_type AS tag, max(ts) AS newest FROM events
    WHERE event_id % 13 <> 0 GROUP BY event_type) m ON e.tag = m.tag AND e."timestamp" = m.newest""")
def latest_by_tag_nulls(spark, sf):
    sparse = app(spark, sf).withColumn("tag", F.when(F.col("event_id") % 13 != 0, F.col("tag")))
    return retrieve.latest_by_tag(sparse, "app_event")


@query(f"SELECT DISTINCT name FROM {EVERYTHING} ORDER BY name")
def event_names(spark, sf):
    return retrieve.event_names(everything(spark, sf))


@query(f'SELECT name, count(*) AS "count" FROM {EVERYTHING} GROUP BY name ORDER BY name')
def event_name_counts(spark, sf):
    return retrieve.event_name_counts(everything(spark, sf))


@query(f"""SELECT *, row_number() OVER (ORDER BY "timestamp", event_id) AS row_index FROM
    (SELECT * FROM {ORDER} ORDER BY "timestamp" DESC, event_id DESC LIMIT 10000)""")
def raw_event_page(spark, sf):
    return retrieve.raw_event_page(order(spark, sf), "order", 10_000)


@query(f"""SELECT * FROM {USER} WHERE name = 'user_view'""")
def source_defaults(spark, sf):
    source = SourceSpec.parse({"id": "picked", "event": "user_{event_name_param}"})
    return source.to_df(user(spark, sf), APP_NOW, {"event_name_param": "view"})


@query(f"SELECT * FROM {ORDER} WHERE tag IN ('F', 'P')")
def source_unlimited(spark, sf):
    source = SourceSpec.parse({"id": "all", "event": "order", "max_age_days": 0, "max_results": 0, "tags": ["F", "P"]})
    return source.to_df(order(spark, sf), ORDER_NOW)


@query(f"""SELECT e.* FROM {ORDER} e JOIN (SELECT tag, max("timestamp") AS newest FROM {ORDER} GROUP BY tag) m
    ON e.tag = m.tag AND e."timestamp" = m.newest""")
def source_latest_unique(spark, sf):
    source = SourceSpec.parse(
        {"id": "now", "event": "order", "max_age_days": 1, "max_results": 1, "last_unique_by_tag": True}
    )
    return source.to_df(order(spark, sf), ORDER_NOW)


@query("""SELECT event_id, event_type AS name,
    CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE trunc(value - 50) + 0.0 END AS DOUBLE) AS value,
    CAST(NULL AS VARCHAR) AS tag, props AS additional_info,
    CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE ts END AS "timestamp" FROM events""")
def normalize_defaults(spark, sf):
    return normalize_events(
        raw_events(spark, sf),
        {
            "event_id": "event_id",
            "name": "event_type",
            "value": F.when(F.col("event_id") % 7 != 0, F.col("value") - 50),
            "additional_info": "props",
            "timestamp": F.when(F.col("event_id") % 5 != 0, F.col("ts")),
        },
        APP_NOW,
        value_mode="int",
    )


@query("""SELECT event_type IS NOT NULL AND event_id % 9 <> 0 AS accepted, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
    FROM events GROUP BY 1""")
def collector_gate(spark, sf):
    records = raw_events(spark, sf).withColumn("name", F.when(F.col("event_id") % 9 != 0, F.col("event_type")))
    kept, dropped = gate_named(records)

    def counted(df: DataFrame, accepted: bool) -> DataFrame:
        one = df.groupBy(F.lit(accepted).alias("accepted"))
        return one.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))

    return counted(kept, True).unionByName(counted(dropped, False))


@query(f"SELECT * FROM {USER} WHERE name = 'user_signup'")
def store_scan(spark, sf):
    path = fresh_dir(spark, "store")
    event_store.append_events(user(spark, sf), path)
    return retrieve.named(event_store.read_events(spark, path), "user_signup")


@query(f"""SELECT name, count(*) AS n, round(sum(value), 2) AS total FROM
    (SELECT * FROM {USER} UNION ALL SELECT * FROM {ORDER} UNION ALL SELECT * FROM {ORDER}) GROUP BY name""")
def store_appends(spark, sf):
    path = fresh_dir(spark, "store")
    event_store.append_events(user(spark, sf), path)
    event_store.append_events(order(spark, sf), path, period="month")
    event_store.append_events(order(spark, sf), path, period="month")
    stored = event_store.read_events(spark, path).groupBy("name")
    return stored.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT 2 * count(*) + 2 AS n, 2 * count(*) + 2 AS ids, true AS growing FROM events""")
def store_ids(spark, sf):
    """Writes of tables and of single events get ids of their own that grow from write to write."""
    path = fresh_dir(spark, "store")
    for _ in range(2):
        event_store.append_events(user(spark, sf), path, new_ids=True)
        event_store.append_event(spark, path, "single", APP_NOW)
    rows = event_store.read_partitions(spark, path)
    counts = [F.count("*").alias("n"), F.count_distinct("event_id").alias("ids")]
    writes = rows.groupBy("write").agg(*counts, F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    before = F.lag("high").over(Window.orderBy("write"))  # four rows
    growing = F.coalesce(F.col("low") > before, F.lit(True))
    return writes.withColumn("growing", growing).agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.min("growing").alias("growing"))


@query("""SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS value, 'total' AS tag, CAST(NULL AS VARCHAR) AS additional_info,
    TIMESTAMP '2024-01-31 00:00:00' AS "timestamp" FROM events GROUP BY 1""")
def store_single_events(spark, sf):
    path = fresh_dir(spark, "store")
    for r in raw_events(spark, sf).groupBy("event_type").count().collect():  # a handful of types
        event_store.append_event(spark, path, r.event_type, APP_NOW, r["count"], "total")
    return event_store.read_events(spark, path).drop("event_id")


@query(f"SELECT * FROM {APP}")
def export_records(spark, sf):
    path = fresh_dir(spark, "export")
    rows = app(spark, sf)
    event_store.export_records(rows, path)
    return event_store.read_records(spark, path, rows.schema)
