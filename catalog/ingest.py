"""Logs, pushed documents and metric samples, all derived from the event table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import APP_NOW, LINEITEM, query, raw_events
from tickloom.functions.timestamps import parse_event_time
from tickloom.operators import metrics
from tickloom.sources import logs, push

# Log lines: `time #severity# module -> message`, some malformed, some blank.
SEVERITY = {"click": "debug", "view": "Info", "signup": "WARNING", "purchase": "ERROR", "error": "CRITICAL"}
LOG_CONFIG = {
    "log_pattern": r"([-0-9]+T[0-9:.]+) #([A-Za-z]+)# (mod[0-9]) -> (.*)",
    "timestamp_format": "%Y-%m-%dT%H:%M:%S.%f",
    "timestamp_group_index": 1,
    "severity_group_index": 2,
    "content_group_index": 4,
}
_SEVERITY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY.items()) + " END"
LOG_SQL = f"""(SELECT event_id, ts, event_id // 1000 AS file, CASE WHEN event_id % 70 = 0 THEN '   '
    WHEN event_id % 50 = 0 THEN 'a line of another layout'
    ELSE '  ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || ' #' || {_SEVERITY_SQL} || '# mod' || CAST(user_id % 10 AS VARCHAR)
        || ' -> user ' || CAST(user_id AS VARCHAR) || ' did ' || event_type || ' for ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
        || CASE WHEN event_id % 9 = 0 THEN ' units' ELSE '' END || '  ' END AS line FROM events)"""
GOOD = "event_id % 70 <> 0 AND event_id % 50 <> 0"
PARSED_SQL = f"""(SELECT event_id, 'log_message' AS name, CAST(1 AS DOUBLE) AS value, upper(regexp_extract(line, '#(\\w+)#', 1)) AS tag,
    regexp_extract(trim(line), '-> (.+)$', 1) AS additional_info, date_trunc('millisecond', ts) AS "timestamp", line
    FROM {LOG_SQL} WHERE {GOOD})"""
LOG_COLUMNS = ["event_id", "name", "value", "tag", "additional_info", "timestamp"]


def log_lines(df):
    severity = F.lit(None).cast("string")
    for kind, text in SEVERITY.items():
        severity = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(severity)
    message = F.concat(
        F.lit("user "),
        F.col("user_id").cast("string"),
        F.lit(" did "),
        "event_type",
        F.lit(" for "),
        F.floor("value").cast("string"),
        F.when(F.col("event_id") % 9 == 0, F.lit(" units")).otherwise(F.lit("")),
    )
    module = F.concat(F.lit("mod"), (F.col("user_id") % 10).cast("string"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    full = F.concat(F.lit("  "), stamp, F.lit(" #"), severity, F.lit("# "), module, F.lit(" -> "), message, F.lit("  "))
    line = (
        F.when(F.col("event_id") % 70 == 0, F.lit("   "))
        .when(F.col("event_id") % 50 == 0, F.lit("a line of another layout"))
        .otherwise(full)
    )
    file = F.floor(F.col("event_id") / 1000).cast("long")
    return df.select("event_id", file.alias("file"), F.col("event_id").alias("pos"), line.alias("line"))


def _parse(lines, config):
    parsed = logs.parse_lines(lines, logs.LogFormat.parse(config), APP_NOW)
    return logs.as_events(parsed, F.col("event_id"))


@query(f'SELECT event_id, name, value, tag, additional_info, "timestamp" FROM {PARSED_SQL}')
def parse_logs(spark, sf):
    return _parse(log_lines(raw_events(spark, sf)), LOG_CONFIG)


@query(f"""SELECT event_id, 'app_log' AS name, value, tag, additional_info, "timestamp" FROM {PARSED_SQL}
    WHERE regexp_matches(line, 'did (click|view|error)') AND NOT regexp_matches(line, 'mod[37]')""")
def parse_logs_filtered(spark, sf):
    extra = {"include_regex": "did (click|view|error)", "exclude_regex": "mod[37]", "event_name": "app_log"}
    return _parse(log_lines(raw_events(spark, sf)), LOG_CONFIG | extra)


@query(f"""SELECT event_id, name, CAST(regexp_extract(line, ' for (\\d+)', 1) AS DOUBLE) AS value, tag,
    regexp_extract(line, 'did (\\w+)', 1) AS additional_info, "timestamp" FROM {PARSED_SQL} WHERE event_id % 9 <> 0""")
def parse_logs_value(spark, sf):
    """Value read from the line; lines where it is no number are dropped."""
    pattern = r"(\S+) #(?P<level>\w+)# \w+ -> user \d+ did (\w+) for (.+)"
    config = LOG_CONFIG | {"log_pattern": pattern, "content_group_index": 3, "value_group_index": 4}
    return _parse(log_lines(raw_events(spark, sf)), config)


@query("""SELECT event_id, 'log_message' AS name, CAST(1 AS DOUBLE) AS value, 'WARNING' AS tag,
    event_type || ' by ' || CAST(user_id AS VARCHAR) AS additional_info, date_trunc('second', ts) AS "timestamp" FROM events""")
def parse_logs_syslog(spark, sf):
    """Times without a year take the year of `as_of`."""
    text = F.concat(
        F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" <warning> "), "event_type", F.lit(" by "), F.col("user_id").cast("string")
    )
    config = {"log_pattern": r"([A-Z][a-z]+ +[0-9]+ [0-9:]+) <([a-z]+)> (.+)", "timestamp_format": "%b %d %H:%M:%S"}
    return _parse(raw_events(spark, sf).select("event_id", text.alias("line")), config)


@query(f"""SELECT event_id, name, value, tag, additional_info, "timestamp" FROM {PARSED_SQL}
    WHERE "timestamp" > TIMESTAMP '2024-01-15 12:00:00'""")
def log_increment(spark, sf):
    return logs.after_cursor(_parse(log_lines(raw_events(spark, sf)), LOG_CONFIG), datetime(2024, 1, 15, 12))


@query(f"""SELECT greatest(max("timestamp"), TIMESTAMP '2024-01-15 12:00:00') AS last_timestamp FROM {PARSED_SQL}""")
def log_cursor(spark, sf):
    cursor = datetime(2024, 1, 15, 12)
    fresh = logs.after_cursor(_parse(log_lines(raw_events(spark, sf)), LOG_CONFIG), cursor)
    return logs.next_cursor(fresh, cursor)


SKIP_PATTERN = "mod5 .*purchase"
SKIPPED_SQL = f"""SELECT p.event_id, p.name, p.value, p.tag, p.additional_info, p."timestamp" FROM {PARSED_SQL} p
    JOIN (SELECT event_id // 1000 AS file, min(event_id) AS first FROM {LOG_SQL}
          WHERE regexp_matches(line, '{SKIP_PATTERN}') GROUP BY 1) f
    ON p.event_id // 1000 = f.file AND p.event_id >= f.first"""


@query(SKIPPED_SQL)
def skip_until_logs(spark, sf):
    return _parse(log_lines(raw_events(spark, sf)), LOG_CONFIG | {"skip_until": SKIP_PATTERN})


@query(f"""SELECT event_id, 'log_message' AS name, CAST(1 AS DOUBLE) AS value, upper(regexp_extract(line, '#(\\w+)#', 1)) AS tag,
    regexp_extract(trim(line), '-> (.+)$', 1) AS additional_info, date_trunc('millisecond', ts) AS "timestamp"
    FROM {LOG_SQL} WHERE {GOOD} AND NOT contains(line, '#Info#')""")
def parse_logs_optional_group(spark, sf):
    """Lines whose severity is not there are dropped, not kept without one."""
    lines = log_lines(raw_events(spark, sf)).withColumn("line", F.regexp_replace("line", "#Info# ", ""))
    config = LOG_CONFIG | {"log_pattern": r"(\S+T\S+) (?:#(\w+)# )?(mod\d) -> (.*)"}
    return _parse(lines, config)


# Pushed documents: ten events each. Some events and some bodies are faulty.
BAD_ITEMS = {
    0: ('{"value": 1}', "missing required 'name' field (string)"),
    1: ('{"name": "app_event", "value": "12"}', "'value' field must be a number"),
    2: ('{"name": "app_event", "tag": 5}', "'tag' field must be a string if provided"),
    3: (
        '{"name": "app_event", "timestamp": "yesterday"}',
        "invalid timestamp format. Use ISO format (e.g., ''2025-01-01T12:00:00Z'')",
    ),
    4: ("17", "must be an object"),
    5: ('{"name": "app_event", "additional_info": true}', "'additional_info' field must be a string if provided"),
    6: ('{"name": "", "value": "x"}', "missing required 'name' field (string)"),
    7: ('{"name": "app_event", "value": null}', "'value' field must be a number"),
}
BAD_BODIES = {
    0: ("[1]", push.NOT_AN_OBJECT),
    1: ('{"events": []}', push.NO_EVENTS),
    2: ('{"events": "x"}', push.NOT_AN_ARRAY),
    3: ("{bad", push.NOT_AN_OBJECT),
    4: ('{"other": [1]}', push.NO_EVENTS),
}
BODY_ERROR_SQL = (
    "CASE (event_id // 10) % 53 "
    + " ".join("WHEN {} THEN '{}'".format(k, m.replace("'", "''")) for k, (_, m) in BAD_BODIES.items())
    + " END"
)
ITEM_ERROR_SQL = (
    "CASE event_id % 97 "
    + " ".join(
        "WHEN {} THEN '{}'".format(k, m if "''" in m else m.replace("'", "''")) for k, (_, m) in BAD_ITEMS.items()
    )
    + " END"
)
JUDGED_SQL = f"""(SELECT *, event_id // 10 AS request_id, CAST(event_id % 10 AS INTEGER) AS pos, {BODY_ERROR_SQL} AS body_error,
    {ITEM_ERROR_SQL} AS item_error, count({ITEM_ERROR_SQL}) OVER (PARTITION BY event_id // 10) AS faults FROM events)"""
ACCEPTED_SQL = """SELECT request_id, pos,
    CASE event_id % 97 WHEN 8 THEN 'app_event' WHEN 9 THEN 'app_event' ELSE 'user_' || event_type END AS name,
    CASE event_id % 97 WHEN 8 THEN 1.0 WHEN 9 THEN 0.0 ELSE trunc(value - 50) + 0.0 END AS value,
    CASE event_id % 97 WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE event_type END AS tag,
    CASE event_id % 97 WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS additional_info,
    CASE event_id % 97 WHEN 8 THEN TIMESTAMP '2024-01-02 03:04:05' WHEN 9 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE ts END AS "timestamp" """
PUSH_COLUMNS = ["request_id", "pos", "name", "value", "tag", "additional_info", "timestamp"]


def push_requests(df):
    fine = F.concat(
        F.lit('{"name": "user_'),
        "event_type",
        F.lit('", "value": '),
        F.round(F.col("value") - 50, 2).cast("decimal(12,2)").cast("string"),
        F.lit(', "tag": "'),
        "event_type",
        F.lit('", "additional_info": "'),
        F.col("user_id").cast("string"),
        F.lit('", "timestamp": "'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit('Z"}'),
    )
    kind = F.col("event_id") % 97
    # Two more accepted forms: a boolean value with an offset time, and nothing but a name.
    item = F.when(kind == 8, F.lit('{"name": "app_event", "value": true, "timestamp": "2024-01-02T05:04:05+02:00"}'))
    item = item.when(kind == 9, F.lit('{"name": "app_event", "tag": null, "timestamp": ""}'))
    for k, (text, _) in BAD_ITEMS.items():
        item = item.when(kind == k, F.lit(text))
    items = df.select(
        F.floor(F.col("event_id") / 10).cast("long").alias("request_id"),
        F.struct("event_id", item.otherwise(fine).alias("item")).alias("at"),
    )
    # Ten consecutive ids make up a request, so a group never holds more than ten items.
    joined = items.groupBy("request_id").agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list("at")), lambda a: a["item"])).alias("items")
    )
    body = F.concat(F.lit('{"events": ['), "items", F.lit("]}"))
    for k, (text, _) in BAD_BODIES.items():
        body = F.when(F.col("request_id") % 53 == k, F.lit(text)).otherwise(body)
    return joined.select("request_id", body.alias("body"))


@query(f"{ACCEPTED_SQL} FROM {JUDGED_SQL} WHERE body_error IS NULL AND faults = 0")
def push_accept(spark, sf):
    accepted, _ = push.split_requests(push_requests(raw_events(spark, sf)), APP_NOW)
    return accepted.select(*PUSH_COLUMNS)


@query(f"""SELECT DISTINCT request_id, CAST(NULL AS INTEGER) AS pos, body_error AS error FROM {JUDGED_SQL} WHERE body_error IS NOT NULL
    UNION ALL SELECT request_id, min(pos), 'Event at index ' || CAST(min(pos) AS VARCHAR) || ' ' || arg_min(item_error, pos)
    FROM {JUDGED_SQL} WHERE body_error IS NULL AND item_error IS NOT NULL GROUP BY request_id""")
def push_quarantine(spark, sf):
    _, rejected = push.split_requests(push_requests(raw_events(spark, sf)), APP_NOW)
    return rejected.select("request_id", "pos", "error")


@query(f"{ACCEPTED_SQL} FROM {JUDGED_SQL} WHERE body_error IS NULL AND item_error IS NULL")
def push_accept_rows(spark, sf):
    accepted, _ = push.split_requests(push_requests(raw_events(spark, sf)), APP_NOW, mode="row")
    return accepted.select(*PUSH_COLUMNS)


@query(f"""SELECT DISTINCT request_id, CAST(NULL AS INTEGER) AS pos, body_error AS error FROM {JUDGED_SQL} WHERE body_error IS NOT NULL
    UNION ALL SELECT request_id, pos, 'Event at index ' || CAST(pos AS VARCHAR) || ' ' || item_error
    FROM {JUDGED_SQL} WHERE body_error IS NULL AND item_error IS NOT NULL""")
def push_quarantine_rows(spark, sf):
    _, rejected = push.split_requests(push_requests(raw_events(spark, sf)), APP_NOW, mode="row")
    return rejected.select("request_id", "pos", "error")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN ts ELSE date_trunc('second', ts) END AS "at"
    FROM events""")
def parse_event_times(spark, sf):
    """Event time texts: plain, inside other text, ISO with fraction, and none at all."""
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit("at "), plain, F.lit(".25 UTC")))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .otherwise(F.lit("noon"))
    )
    return raw_events(spark, sf).select("event_id", parse_event_time(text).alias("at"))


# Metric samples.
def counter_samples(df):
    """A growing counter per user that falls back to 0 now and then."""
    value = F.when(F.col("event_id") % 200 == 0, F.lit(0)).otherwise(F.col("event_id") * 1000)
    return df.select(
        "event_id",
        F.lit("requests").alias("name"),
        F.col("user_id").cast("string").alias("tag"),
        value.cast("double").alias("value"),
        F.col("ts").alias("timestamp"),
    )


def _rates_sql(kept: str) -> str:
    return f"""SELECT event_id, name, tag, CASE WHEN {kept} THEN CAST(trunc((value - pv) / ((epoch_us("timestamp") - epoch_us(pt)) / 1000000.0)) AS BIGINT) END AS value,
        "timestamp" FROM (SELECT *, lag(value) OVER w AS pv, lag("timestamp") OVER w AS pt FROM
            (SELECT event_id, 'requests' AS name, CAST(user_id AS VARCHAR) AS tag,
                CAST(CASE WHEN event_id % 200 = 0 THEN 0 ELSE event_id * 1000 END AS DOUBLE) AS value, ts AS "timestamp" FROM events)
            WINDOW w AS (PARTITION BY tag ORDER BY "timestamp", event_id)) WHERE pt IS NOT NULL"""


@query(_rates_sql("true"))
def counter_rates(spark, sf):
    return metrics.counter_rates(counter_samples(raw_events(spark, sf)))


@query(_rates_sql("value >= pv"))
def counter_rates_resets(spark, sf):
    return metrics.counter_rates(counter_samples(raw_events(spark, sf)), on_reset="null")


@query("""SELECT event_id, ts AS "timestamp", u.name, u.value FROM events, LATERAL (VALUES
    ('io_read_count', CAST(event_id * 3 AS DOUBLE)), ('io_write_count', CAST(user_id * 7 AS DOUBLE)),
    ('io_read_bytes', value * 1000), ('io_write_bytes', value * 500)) u(name, value)""")
def sample_unpivot(spark, sf):
    wide = raw_events(spark, sf).select(
        "event_id",
        F.col("ts").alias("timestamp"),
        (F.col("event_id") * 3).alias("read_count"),
        (F.col("user_id") * 7).alias("write_count"),
        (F.col("value") * 1000).alias("read_bytes"),
        (F.col("value") * 500).alias("write_bytes"),
    )
    names = {f"{d}_{u}": f"io_{d}_{u}" for d in ("read", "write") for u in ("count", "bytes")}
    return metrics.sample_events(wide, names, ["event_id", "timestamp"])


@query("""SELECT event_id, CAST(trunc(b / 1048576) AS BIGINT) AS truncated, CAST(floor(b / 1048576) AS BIGINT) AS floored
    FROM (SELECT event_id, (value - 50) * 1000000 AS b FROM events)""")
def unit_scale(spark, sf):
    size = (F.col("value") - 50) * 1000000
    return raw_events(spark, sf).select(
        "event_id", metrics.to_mb(size).alias("truncated"), metrics.to_mb(size, "floor").alias("floored")
    )


@query("""SELECT event_id, CAST(greatest(0, least(100, 100 - (event_id % 121 - 10))) AS DOUBLE) AS busy FROM events""")
def clamp_percent(spark, sf):
    idle = (F.col("event_id") % 121 - 10).cast("double")
    return raw_events(spark, sf).select("event_id", metrics.busy_percent(idle).alias("busy"))


@query("""SELECT l_returnflag || CASE WHEN l_linenumber = 1 THEN '' ELSE ',disk:' || l_linestatus || ':' || CAST(l_linenumber AS VARCHAR) END AS tag,
    l_returnflag AS metric, CASE WHEN l_linenumber <> 1 THEN 'disk' END AS dimension,
    CASE WHEN l_linenumber <> 1 THEN l_linestatus || ':' || CAST(l_linenumber AS VARCHAR) END AS instance, count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3, 4""")
def composite_tag(spark, sf):
    lines = spark.read.schema(LINEITEM).parquet(f"{sf}/lineitem.parquet")
    unit = F.when(
        F.col("l_linenumber") != 1, F.concat("l_linestatus", F.lit(":"), F.col("l_linenumber").cast("string"))
    )
    tagged = lines.select(metrics.composite_tag(F.col("l_returnflag"), "disk", unit).alias("tag"))
    metric, dimension, instance = metrics.split_tag(F.col("tag"))
    parts = tagged.select("tag", metric.alias("metric"), dimension.alias("dimension"), instance.alias("instance"))
    return parts.groupBy("tag", "metric", "dimension", "instance").agg(F.count(F.lit(1)).alias("n"))
