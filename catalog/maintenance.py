"""Retention and run statistics."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from catalog.base import APP, APP_NOW, EVERYTHING, USER, app, everything, mean_sql, query, raw_events, user
from tickloom.operators import retention, stats
from tickloom.plans.view import run_view
from tickloom.session import fresh_dir
from tickloom.sources import event_store, folders, merging, rollups
from tickloom.sources.collectors import Collector, run_collectors

RULES = [
    retention.RetentionRule.parse(r)
    for r in (
        {"event_name": "user_click", "tag": "3", "max_age_days": 7},
        {"event_name": "user_click", "max_age_days": 14},
        {"event_name": "user_view", "tag": "", "max_age_days": 20},
        {"event_name": "app_event", "tag": "error", "max_age_days": 10},
        {"event_name": "order", "max_age_days": 9000},
        {"event_name": "shipment", "max_age_days": 8500},
        {"event_name": "no such event", "max_age_days": 1},
    )
]
RULE_SQL = """CASE
    WHEN name = 'user_click' AND tag = '3' AND "timestamp" < TIMESTAMP '2024-01-24 00:00:00' THEN 0
    WHEN name = 'user_click' AND "timestamp" < TIMESTAMP '2024-01-17 00:00:00' THEN 1
    WHEN name = 'user_view' AND "timestamp" < TIMESTAMP '2024-01-11 00:00:00' THEN 2
    WHEN name = 'app_event' AND tag = 'error' AND "timestamp" < TIMESTAMP '2024-01-21 00:00:00' THEN 3
    WHEN name = 'order' AND "timestamp" < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '9000 days' THEN 4
    WHEN name = 'shipment' AND "timestamp" < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '8500 days' THEN 5 END"""


@query(f"""SELECT event_id, name, value, tag, additional_info, "timestamp" FROM {USER} WHERE {RULE_SQL} IS NULL""")
def retention_kept(spark, sf):
    return retention.retained(user(spark, sf), RULES, APP_NOW)


@query(f"""SELECT r.rule_idx, r.event_name, r.tag, r.max_age_days, coalesce(d.n, 0) AS deleted FROM
    (VALUES (0, 'user_click', '3', CAST(7 AS DOUBLE)), (1, 'user_click', NULL, 14), (2, 'user_view', NULL, 20),
     (3, 'app_event', 'error', 10), (4, 'order', NULL, 9000), (5, 'shipment', NULL, 8500),
     (6, 'no such event', NULL, 1)) r(rule_idx, event_name, tag, max_age_days)
    LEFT JOIN (SELECT {RULE_SQL} AS rule_idx, count(*) AS n FROM {EVERYTHING} GROUP BY 1) d ON r.rule_idx = d.rule_idx""")
def retention_deleted_counts(spark, sf):
    return retention.deleted_counts(everything(spark, sf), RULES, APP_NOW)


@query(f"""SELECT * FROM (SELECT * FROM {USER} UNION ALL SELECT * FROM {APP}) WHERE {RULE_SQL} IS NULL""")
def retention_in_place(spark, sf):
    path = fresh_dir(spark, "store")
    event_store.append_events(user(spark, sf).unionByName(app(spark, sf)), path)
    event_store.apply_retention(spark, path, RULES, APP_NOW)
    return event_store.read_events(spark, path)


def _many_writes(spark, sf, rows, writes, period="month"):
    path = fresh_dir(spark, "store")
    for part in range(writes):
        event_store.append_events(rows.where(F.pmod("event_id", F.lit(writes)) == part), path, period)
    return path


@query(f"""SELECT * FROM (SELECT * FROM {USER} UNION ALL SELECT * FROM {APP}) WHERE {RULE_SQL} IS NULL""")
def store_merged(spark, sf):
    """Many small writes are merged, more come, some expire, and all is merged again: rows and ids stay."""
    path = _many_writes(spark, sf, user(spark, sf), 9)
    merging.merge_writes(spark, path, at_least=4)
    event_store.append_events(app(spark, sf), path, "month")
    event_store.apply_retention(spark, path, RULES, APP_NOW)
    merging.merge_writes(spark, path, at_least=2)
    return event_store.read_events(spark, path)


@query("""SELECT (SELECT count(DISTINCT event_type) FROM events) AS names, 9 * (SELECT count(DISTINCT event_type) FROM events) AS before,
    (SELECT count(DISTINCT event_type) FROM events) AS after""")
def store_merged_folders(spark, sf):
    """Folders of a month in nine writes, before and after merging: one for each name is left."""
    path = _many_writes(spark, sf, user(spark, sf).withColumn("timestamp", F.date_trunc("month", "timestamp")), 9)
    count = lambda: folders.table_folders(spark, path).count()
    before = count()
    merging.merge_writes(spark, path)
    names = event_store.read_events(spark, path).agg(F.count_distinct("name").alias("names"))
    return names.withColumns({"before": F.lit(before).cast("long"), "after": F.lit(count()).cast("long")})


ROLLUP_VIEW = {
    "id": "kept",
    "data": [
        {"id": "all", "event": "app_event"},
        {"id": "recent", "event": "app_event", "max_age_days": 12.7},
        {"id": "errors", "event": "app_event", "tags": ["error"]},
    ],
    "widgets": [
        *[
            {"title": kind, "type": "counter", "data_sources": ["recent"], "counter_type": kind}
            for kind in ("last", "first", "average", "max", "min", "count", "diff_last_first", "diff_max_min")
        ],
        {"title": "pie", "type": "pie_chart", "data_sources": [{"id": "errors"}, {"id": "all", "tags": ["view", "click"]}], "style": {"aggregation_type": "count"}},
        {"title": "weeks", "type": "bar_graph", "data_sources": ["errors"], "time_aggregation": {"starting_value": "week", "aggregation_function": "count"}},
    ],
}
_RECENT = f"""(SELECT * FROM {APP} WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '{round(12.7 * 86400)} seconds'
    AND NOT (tag = 'error' AND "timestamp" < TIMESTAMP '2024-01-21 00:00:00'))"""
_KEPT_APP = f"""(SELECT * FROM {APP} WHERE NOT (tag = 'error' AND "timestamp" < TIMESTAMP '2024-01-21 00:00:00'))"""


@query(f"""WITH r AS (SELECT arg_max(value, ("timestamp", event_id)) AS l, arg_min(value, ("timestamp", event_id)) AS f, {mean_sql("avg(value)")} AS a,
        max(value) AS h, min(value) AS o, CAST(count(*) AS DOUBLE) AS n FROM {_RECENT}),
    pie AS (SELECT 0 AS i, CAST(count(*) AS DOUBLE) AS v FROM {_KEPT_APP} WHERE tag = 'error'
        UNION ALL SELECT 1, count(*) FROM {_KEPT_APP} WHERE tag IN ('view', 'click'))
    SELECT title, CAST(NULL AS TIMESTAMP) AS "timestamp", round(value, 4) AS value FROM r, LATERAL (VALUES ('last', l), ('first', f), ('average', a), ('max', h),
        ('min', o), ('count', n), ('diff_last_first', l - f), ('diff_max_min', h - o)) t(title, value)
    UNION ALL SELECT 'pie ' || CAST(i AS VARCHAR), NULL, v FROM pie
    UNION ALL SELECT 'weeks', s.b, coalesce(v.n, 0) FROM
        (SELECT unnest(generate_series((SELECT date_trunc('week', min("timestamp")) FROM {_KEPT_APP} WHERE tag = 'error'), TIMESTAMP '2024-01-31 00:00:00', INTERVAL 7 DAY)) AS b) s
        LEFT JOIN (SELECT CAST(date_trunc('week', "timestamp") AS TIMESTAMP) AS b, CAST(count(*) AS DOUBLE) AS n FROM {_KEPT_APP} WHERE tag = 'error' GROUP BY 1) v ON v.b = s.b""")
def view_from_rollup(spark, sf):
    """A view answered from kept hourly partials, after appends, retention and merging."""
    path, kept = fresh_dir(spark, "store"), fresh_dir(spark, "rollup")
    rows = app(spark, sf)
    for part in range(3):
        event_store.append_events(rows.where(F.pmod("event_id", F.lit(3)) == part), path, "month")
        rollups.refresh(spark, path, kept)
    event_store.apply_retention(spark, path, RULES, APP_NOW)
    merging.merge_writes(spark, path, at_least=2)
    rollups.refresh(spark, path, kept)
    result = run_view(event_store.read_events(spark, path), ROLLUP_VIEW, APP_NOW, kept=rollups.read_rollup(spark, path, kept))
    parts = []
    for title, frame in result.widgets.items():
        name = F.concat(F.lit("pie "), F.col("series_idx").cast("string")) if title == "pie" else F.lit(title)
        moment = F.col("timestamp") if title == "weeks" else F.lit(None).cast("timestamp")
        parts.append(frame.select(name.alias("title"), moment.alias("timestamp"), F.round(F.col("value").cast("double"), 4).alias("value")))
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"""SELECT * FROM {USER} WHERE {RULE_SQL} IS NULL""")
def retention_copy(spark, sf):
    path, target = fresh_dir(spark, "store"), fresh_dir(spark, "store")
    event_store.append_events(user(spark, sf), path)
    event_store.copy_retained(spark, path, target, RULES, APP_NOW)
    return event_store.read_events(spark, target)


@query(f"SELECT count(*) AS n, CAST(2 AS BIGINT) AS refused FROM {USER}")
def retention_refused(spark, sf):
    """Rules without a name or an age are refused as a whole, before anything is deleted."""
    path, refused = fresh_dir(spark, "store"), 0
    event_store.append_events(user(spark, sf), path)
    good = retention.RetentionRule.parse({"event_name": "user_click", "max_age_days": 1})
    for bad in (retention.RetentionRule("", 1), retention.RetentionRule("user_view", None)):
        try:
            event_store.apply_retention(spark, path, [good, bad], APP_NOW)
        except ValueError:
            refused += 1
    return event_store.read_events(spark, path).agg(F.count("*").alias("n"), F.lit(refused).cast("long").alias("refused"))


def _collect_users(spark, config, cursor):
    rows = user(spark, config["folder"]).withColumn("name", F.when(F.col("event_id") % 9 != 0, F.col("name")).otherwise(""))
    ready = rows.where(F.col("timestamp") < F.lit(config["until"]).cast("timestamp"))
    return ready if cursor is None else ready.where(F.col("timestamp") > F.lit(cursor))


@query(f"""SELECT name, value, tag, additional_info, "timestamp" FROM {USER} WHERE event_id % 9 <> 0""")
def collector_runs(spark, sf):
    """A collector run twice: the second run goes on behind the cursor of the first."""
    store, cursors, log = (fresh_dir(spark, x) for x in ("store", "cursors", "runs"))
    for until in ("2024-01-15", "2025-01-01"):
        collector = Collector("users", _collect_users, {"folder": sf, "until": until})
        run_collectors(spark, [collector], store, cursors, log, APP_NOW)
    return event_store.read_events(spark, store).drop("event_id")


@query("""SELECT event_type AS module, CAST(user_id % 3 AS VARCHAR) AS unique_id, count(*) AS runs_count,
    count(*) FILTER (event_id % 11 = 0) AS errors_count,
    CAST(coalesce(sum(user_id) FILTER (event_id % 11 <> 0), 0) AS BIGINT) AS collected_events,
    CAST(ceil(coalesce(avg(value) FILTER (event_id % 11 <> 0), 0)) AS BIGINT) AS avg_execution_time_ms,
    max(ts) AS last_execution_time,
    CASE WHEN arg_max(event_id, ts) % 11 = 0 THEN 'failed at ' || CAST(arg_max(event_id, ts) AS VARCHAR) ELSE '' END AS error_message,
    CAST(sum(event_id % 2) AS BIGINT) AS cleanup_times, CAST(sum(event_id % 5) AS BIGINT) AS deleted_events_count
    FROM events GROUP BY 1, 2""")
def run_stats(spark, sf):
    failed = F.col("event_id") % 11 == 0
    log = raw_events(spark, sf).select(
        F.col("event_type").alias("module"),
        (F.col("user_id") % 3).cast("string").alias("unique_id"),
        F.col("ts").alias("started"),
        F.col("value").alias("duration_ms"),
        F.col("user_id").alias("n_events"),
        (F.col("event_id") % 2).alias("cleanups"),
        (F.col("event_id") % 5).alias("deleted"),
        F.when(failed, F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"),
    )
    return stats.run_stats(log)


MEAN = mean_sql("coalesce(avg(value) FILTER (event_id % 4 <> 0), 0)", 2)


@query(f"""SELECT 'name=' || event_type || ';max_results=' || CAST(user_id AS VARCHAR) AS api_name, count(*) AS total_calls,
    count(*) FILTER (event_id % 4 = 0) AS total_errors,
    {MEAN} AS avg_response_time_ms,
    round(coalesce(max(value) FILTER (event_id % 4 <> 0), 0), 2) AS max_response_time_ms FROM events GROUP BY 1""")
def query_stats(spark, sf):
    key = F.concat(F.lit("name="), "event_type", F.lit(";max_results="), F.col("user_id").cast("string"))
    log = raw_events(spark, sf).select(
        key.alias("key"), F.col("value").alias("duration_ms"), (F.col("event_id") % 4 == 0).alias("failed")
    )
    return stats.query_stats(log)
