"""Widget results and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    APP,
    APP_NOW,
    ORDER,
    ORDER_NOW,
    SHIP,
    TIME_TEXT,
    USER,
    app,
    mean_sql,
    order,
    query,
    ship,
    user,
)
from tickloom.functions.conditions import evaluate
from tickloom.operators import charts, tables
from tickloom.operators.series import series_frame
from tickloom.operators.timeseries import interval_aggregate
from tickloom.plans.specs import SeriesSpec
from tickloom.plans.view import run_view

UNLIMITED = {"max_age_days": 0, "max_results": 0}

# A monitor page over all app events: gauge, counters, lines, bars, slices.
MONITOR = {
    "id": "monitor",
    "default_time_aggregation": "day",
    "data": [
        {"id": "all", "event": "app_event", **UNLIMITED},
        {"id": "every", "event": "app_event"},
    ],
    "widgets": [
        {
            "title": "Last value",
            "type": "gauge",
            "data_sources": [{"id": "all", "mutators": [{"operation": "subtract", "value": 50}]}],
            "aggregation_type": "min",
            "show_last_value_time": True,
            "style": {"min": 0, "max": 200, "axis_colors": [[10, "success"], [20, "warning"], [100, "danger"]]},
        },
        {"title": "Spread", "type": "counter", "data_sources": ["all"], "counter_type": "diff_max_min"},
        {
            "title": "Errors in range",
            "type": "counter",
            "data_sources": [{"id": "all", "tags": ["error"]}],
            "counter_type": "count",
            "time_range_filter": True,
        },
        {
            "title": "Daily mean",
            "type": "line_graph",
            "data_sources": [{"id": "every", "tags": ["click", "view"]}, "every"],
            "time_aggregation": {"starting_value": "page_default", "aggregation_function": "average"},
        },
        {
            "title": "Weekly sums",
            "type": "bar_graph",
            "data_sources": [{"id": "all", "tags": ["error"]}, {"id": "all", "tags": ["none such"]}],
            "time_aggregation": {"starting_value": "week", "choices": ["day", "week"]},
        },
        {
            "title": "Shares",
            "type": "pie_chart",
            "data_sources": [
                {"id": "all", "tags": ["click", "view"]},
                {"id": "all", "tags": ["purchase"]},
                {"id": "all", "tags": ["none such"]},
            ],
            "style": {"labels": ["Browsing"], "aggregation_type": "sum"},
        },
        {
            "title": "Latest",
            "type": "table",
            "data_sources": ["every"],
            "max_rows": 50,
            "slice_from": "end",
            "filters": [{"field": "kind"}, {"field": "reading", "choices": 5}, {"field": "no such column"}],
            "table_columns": [
                {"title": "idx", "event_field": "index"},
                {"title": "kind", "event_field": "tag"},
                {"title": "reading", "event_field": "value"},
                {"title": "at", "event_field": "time"},
            ],
            "color_rules": [
                {"event_field": "value", "condition": "greater_than", "value": 100, "color": "warning"},
                {"event_field": "tag", "condition": "equals", "value": "error", "color": "danger"},
            ],
        },
        {"title": "Missing", "type": "counter", "data_sources": ["nowhere"], "counter_type": "sum"},
        {"title": "Text", "type": "html_box", "html_content": "<p>text</p>"},
    ],
}


def _monitor(spark, sf, title, **kwargs):
    page = MONITOR | {"widgets": [w for w in MONITOR["widgets"] if w["title"] == title]}
    return run_view(app(spark, sf), page, APP_NOW, **kwargs).widgets[title]


@query(f"""SELECT abs(min(value - 50)) AS value, CASE WHEN abs(min(value - 50)) / 200 * 100 <= 10 THEN 'success'
    WHEN abs(min(value - 50)) / 200 * 100 <= 20 THEN 'warning' ELSE 'danger' END AS zone,
    max("timestamp") AS last_time FROM {APP}""")
def gauge_widget(spark, sf):
    return _monitor(spark, sf, "Last value")


@query(f"""SELECT tag, CASE WHEN p <= 30 THEN 'low' WHEN p <= 70 THEN 'middle' ELSE 'high' END AS zone, count(*) AS n FROM
    (SELECT tag, greatest(0, least(100, (value - 5) / (45 - 5) * 100)) AS p FROM {SHIP}) GROUP BY 1, 2""")
def gauge_zones(spark, sf):
    zone = charts.gauge_zone(F.col("value"), [[30, "low"], [70, "middle"], [90, "high"]], 5, 45)
    return ship(spark, sf).groupBy("tag", zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CASE WHEN value <= 30 THEN '#67e0e3' WHEN value <= 70 THEN '#37a2da' ELSE '#fd666d' END AS zone, count(*) AS n
    FROM {APP} GROUP BY 1""")
def gauge_default_zones(spark, sf):
    zone = charts.gauge_zone(F.col("value")).alias("zone")
    return app(spark, sf).groupBy(zone).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT max(value) - min(value) AS value FROM {APP}")
def counter_widget(spark, sf):
    return _monitor(spark, sf, "Spread")


@query(f"""SELECT count(*) AS value FROM {APP} WHERE tag = 'error' AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00'
    AND "timestamp" < TIMESTAMP '2024-01-20 00:00:00'""")
def counter_widget_range(spark, sf):
    return _monitor(spark, sf, "Errors in range", time_range=("2024-01-05", "2024-01-20"))


@query(f"""SELECT s.series_idx, s."timestamp", v.value FROM (SELECT i.series_idx, t."timestamp" FROM
        (SELECT unnest(generate_series((SELECT CAST(date_trunc('day', min("timestamp")) AS TIMESTAMP) FROM {APP}), TIMESTAMP '2024-01-31 00:00:00', INTERVAL '1 day'))
        AS "timestamp") t, (VALUES (0), (1)) i(series_idx)) s LEFT JOIN
    (SELECT 0 AS series_idx, CAST(date_trunc('day', "timestamp") AS TIMESTAMP) AS b, {mean_sql("avg(value)")} AS value
        FROM {APP} WHERE tag IN ('click', 'view') GROUP BY 1, 2 UNION ALL
     SELECT 1, CAST(date_trunc('day', "timestamp") AS TIMESTAMP), {mean_sql("avg(value)")} FROM {APP} GROUP BY 1, 2) v
    ON s.series_idx = v.series_idx AND s."timestamp" = v.b""")
def line_widget(spark, sf):
    return _monitor(spark, sf, "Daily mean")


@query(f"""SELECT s.series_idx, s."timestamp", coalesce(v.value, 0) AS value FROM (SELECT i.series_idx, t."timestamp" FROM
        (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL '7 days'))
        AS "timestamp") t, (VALUES (0), (1)) i(series_idx)) s LEFT JOIN
    (SELECT 0 AS series_idx, CAST(date_trunc('week', "timestamp") AS TIMESTAMP) AS b, round(sum(value), 2) AS value
        FROM {APP} WHERE tag = 'error' GROUP BY 1, 2) v ON s.series_idx = v.series_idx AND s."timestamp" = v.b""")
def bar_widget(spark, sf):
    return _monitor(spark, sf, "Weekly sums").withColumn("value", F.round("value", 2))


@query(f"""SELECT s.series_idx, s."timestamp", coalesce(v.value, 0) AS value FROM (SELECT i.series_idx, t."timestamp" FROM
        (SELECT unnest(generate_series((SELECT CAST(date_trunc('day', min("timestamp")) AS TIMESTAMP) FROM {APP} WHERE tag = 'error'),
            TIMESTAMP '2024-01-31 00:00:00', INTERVAL '1 day')) AS "timestamp") t, (VALUES (0), (1)) i(series_idx)) s LEFT JOIN
    (SELECT 0 AS series_idx, CAST(date_trunc('day', "timestamp") AS TIMESTAMP) AS b, round(sum(value), 2) AS value
        FROM {APP} WHERE tag = 'error' GROUP BY 1, 2) v ON s.series_idx = v.series_idx AND s."timestamp" = v.b""")
def bar_widget_chosen_interval(spark, sf):
    """The reader picks another of the offered intervals."""
    return _monitor(spark, sf, "Weekly sums", intervals={"Weekly sums": "day"}).withColumn("value", F.round("value", 2))


@query(f"""WITH sums AS (SELECT 0 AS series_idx, 'Browsing' AS label, coalesce(sum(value), 0) AS v FROM {APP}
        WHERE tag IN ('click', 'view') UNION ALL
    SELECT 1, 'all [purchase]', coalesce(sum(value), 0) FROM {APP} WHERE tag = 'purchase' UNION ALL
    SELECT 2, 'all [none such]', 0.0)
    SELECT series_idx, label, round(v, 2) AS value, round(sum(v) OVER (), 2) AS total,
        {mean_sql('v / sum(v) OVER () * 100', 2)} AS share FROM sums""")
def pie_widget(spark, sf):
    slices = _monitor(spark, sf, "Shares")
    return slices.withColumns({c: F.round(c, 2) for c in ("value", "total")})


@query(f"""SELECT row_number() OVER (ORDER BY "timestamp", event_id) AS idx, tag AS kind, value AS reading, {TIME_TEXT} AS "at",
        CASE WHEN tag = 'error' THEN 'table-danger' WHEN value > 100 THEN 'table-warning' ELSE '' END AS row_class,
        row_number() OVER (ORDER BY "timestamp", event_id) AS row_position
    FROM {APP} QUALIFY row_number() OVER (ORDER BY "timestamp" DESC, event_id DESC) <= 50""")
def table_widget(spark, sf):
    return _monitor(spark, sf, "Latest")


@query(f"""SELECT 'kind' AS field, tag AS choice FROM (SELECT DISTINCT tag FROM {APP}) UNION ALL
    SELECT 'reading', choice FROM (SELECT CASE WHEN value = trunc(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
        ELSE CAST(value AS VARCHAR) END AS choice, count(*) AS n FROM {APP} GROUP BY 1 ORDER BY n DESC, choice LIMIT 5)""")
def table_widget_choices(spark, sf):
    page = MONITOR | {"widgets": [w for w in MONITOR["widgets"] if w["type"] == "table"]}
    choices = run_view(app(spark, sf), page, APP_NOW).choices
    kind, reading = (choices["Latest", f].withColumn("field", F.lit(f)) for f in ("kind", "reading"))
    return kind.unionByName(reading)


@query(f"""WITH counts(title, type, n_rows) AS (
    SELECT 'Last value', 'gauge', (SELECT count(*) FROM {APP})
    UNION ALL SELECT 'Spread', 'counter', (SELECT count(*) FROM {APP})
    UNION ALL SELECT 'Errors in range', 'counter', (SELECT count(*) FROM {APP} WHERE tag = 'error')
    UNION ALL SELECT 'Daily mean', 'line_graph',
        (SELECT count(DISTINCT date_trunc('day', "timestamp")) FROM {APP} WHERE tag IN ('click', 'view'))
        + (SELECT count(DISTINCT date_trunc('day', "timestamp")) FROM {APP})
    UNION ALL SELECT 'Weekly sums', 'bar_graph', (SELECT count(DISTINCT date_trunc('week', "timestamp")) FROM {APP} WHERE tag = 'error')
    UNION ALL SELECT 'Shares', 'pie_chart', (SELECT count(*) FROM {APP} WHERE tag IN ('click', 'view', 'purchase'))
    UNION ALL SELECT 'Latest', 'table', (SELECT count(*) FROM {APP}))
    SELECT 'monitor' AS view_id, title, type, n_rows, n_rows = 0 AS is_empty FROM counts""")
def view_summary(spark, sf):
    return run_view(app(spark, sf), MONITOR, APP_NOW).summary()


@query(f"""SELECT CASE WHEN name = 'user_click' THEN 0 ELSE 1 END AS series_idx,
        coalesce(CAST(nullif(regexp_extract(info, '^[0-9]+'), '') AS DOUBLE), CAST(epoch_us("timestamp") // 1000 AS DOUBLE)) AS x,
        value AS y
    FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN additional_info || 'ms' ELSE additional_info END AS info
          FROM {USER} WHERE name IN ('user_click', 'user_view'))""")
def scatter_widget(spark, sf):
    unit = F.when(F.col("event_id") % 5 == 0, "n/a").when(
        F.col("event_id") % 5 == 1, F.concat("additional_info", F.lit("ms"))
    )
    events = user(spark, sf).withColumn("additional_info", F.coalesce(unit, F.col("additional_info")))
    view = {
        "id": "points",
        "data": [
            {"id": "clicks", "event": "user_click", **UNLIMITED},
            {"id": "views", "event": "user_view", **UNLIMITED},
        ],
        "widgets": [{"title": "Points", "type": "scatter_map", "data_sources": ["clicks", "views"]}],
    }
    return run_view(events, view, APP_NOW).widgets["Points"]


@query(f"""SELECT x.b AS "timestamp", x.v AS x, y.v AS y FROM
    (SELECT date_trunc('hour', "timestamp") AS b, max(value) AS v FROM {APP} WHERE tag = 'click' GROUP BY 1) x JOIN
    (SELECT date_trunc('hour', "timestamp") AS b, max(value) AS v FROM {APP} WHERE tag = 'view' GROUP BY 1) y ON x.b = y.b""")
def scatter_pairs(spark, sf):
    series = [SeriesSpec.parse({"id": "app", "tags": [t]}) for t in ("click", "view")]
    return charts.scatter_pairs(interval_aggregate(series_frame({"app": app(spark, sf)}, series), "hour", "max"))


# A log-like table over orders.
COLUMNS = [
    {"title": "idx", "event_field": "index"},
    {"title": "status", "event_field": "tag"},
    {"title": "priority", "event_field": "additional_info"},
    {"title": "price", "event_field": "value"},
    {"title": "at", "event_field": "time"},
    {"title": "event", "event_field": "event_name"},
]
RULES = [
    {"event_field": "value", "condition": "greater_than", "value": "100000", "color": "info"},
    {"event_field": "value", "condition": "less_than", "value": 2000, "color": "secondary"},
    {"event_field": "additional_info", "condition": "contains", "value": "URGENT", "color": "warning"},
    {"event_field": "tag", "condition": "not_equals", "value": "F", "color": "success"},
    {"event_field": "tag", "condition": "equals", "value": "P", "color": "danger fw-bold"},
    {"event_field": "tag", "condition": "sounds_like", "value": "F", "color": "primary"},
]
RULES_SQL = """CASE WHEN tag = 'P' THEN 'table-danger fw-bold' WHEN tag <> 'F' THEN 'table-success'
    WHEN contains(additional_info, 'URGENT') THEN 'table-warning' WHEN value < 2000 THEN 'table-secondary'
    WHEN value > 100000 THEN 'table-info' ELSE '' END"""


def _table_sql(source: str, where: str) -> str:
    return f"""SELECT idx, tag AS status, additional_info AS priority, value AS price, {TIME_TEXT} AS "at", name AS event,
        {RULES_SQL} AS row_class, idx AS row_position
        FROM (SELECT *, row_number() OVER (ORDER BY source_pos, "timestamp", event_id) AS idx, count(*) OVER () AS total
              FROM {source}) WHERE {where}"""


TWO = f"(SELECT 0 AS source_pos, * FROM {USER} WHERE name = 'user_error' UNION ALL SELECT 1, * FROM {ORDER})"
ONE = f"(SELECT 0 AS source_pos, * FROM {ORDER})"


@query(_table_sql(TWO, "idx <= 3000"))
def table_slice_start(spark, sf):
    rows = tables.union_sources([user(spark, sf).where("name = 'user_error'"), order(spark, sf)])
    return tables.table(rows, COLUMNS, 3000, "start", RULES)


@query(_table_sql(TWO, "idx > total - 1000"))
def table_slice_end(spark, sf):
    rows = tables.union_sources([user(spark, sf).where("name = 'user_error'"), order(spark, sf)])
    return tables.table(rows, COLUMNS, 1000, "end", RULES)


@query(_table_sql(TWO, "true"))
def table_unsliced(spark, sf):
    rows = tables.union_sources([user(spark, sf).where("name = 'user_error'"), order(spark, sf)])
    return tables.table(rows, COLUMNS, 0, "start", RULES)


@query(_table_sql(ONE, "idx <= 5000 AND tag IN ('F', 'P') AND additional_info IN ('1-URGENT', '3-MEDIUM')"))
def table_filtered(spark, sf):
    rows = tables.union_sources([order(spark, sf)])
    chosen = {"status": ["F", "P"], "priority": ["1-URGENT", "3-MEDIUM"]}
    return tables.table(rows, COLUMNS, 5000, "start", RULES, chosen)


@query(f"SELECT DISTINCT additional_info AS choice FROM {ORDER} ORDER BY 1")
def table_filter_choices(spark, sf):
    return tables.filter_choices(order(spark, sf), "additional_info")


@query(f"SELECT CAST(CAST(value AS BIGINT) AS VARCHAR) AS choice FROM {SHIP} GROUP BY 1")
def table_value_choices(spark, sf):
    return tables.filter_choices(ship(spark, sf), "value")


@query(f"SELECT additional_info AS choice FROM {USER} GROUP BY 1 ORDER BY count(*) DESC, additional_info LIMIT 20")
def table_top_k_choices(spark, sf):
    return tables.filter_choices(user(spark, sf), "additional_info", 20)


# Value k comes about 1 / k as often as the first: few values are common, most occur once or twice.
ZIPF_SQL = "CAST(CAST(floor(pow(8192.0, (event_id * 7919 % 100003) / 100003.0)) AS BIGINT) AS VARCHAR)"


@query(f"""SELECT choice FROM (SELECT {ZIPF_SQL} AS choice, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, choice LIMIT 12""")
def table_heavy_choices(spark, sf):
    """The most common of thousands of values, from candidates that are counted exactly."""
    place = F.pmod(F.col("event_id") * 7919, F.lit(100003)) / F.lit(100003.0)
    rows = app(spark, sf).withColumn("additional_info", F.floor(F.pow(F.lit(8192.0), place)).cast("long").cast("string"))
    return tables.heavy_choices(rows, "additional_info", 12, tracked=64)


@query(f"""SELECT choice, (SELECT count(*) FROM {ORDER} WHERE tag = choice) AS n FROM (VALUES ('F'), ('P'), ('5')) c(choice)""")
def table_listed_choices(spark, sf):
    """Choices listed by the config, in full, with the rows behind each."""
    rows = order(spark, sf)
    offered = tables.filter_choices(rows, "tag", ["F", "P", 5.0])
    counts = rows.groupBy(F.col("tag").alias("choice")).agg(F.count(F.lit(1)).alias("n"))
    return offered.join(counts, "choice", "left").select("choice", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""SELECT series_idx, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT 0 AS series_idx, * FROM {ORDER} UNION ALL
    SELECT 1, * FROM {ORDER} WHERE tag = 'F' UNION ALL SELECT 2, * FROM {ORDER} WHERE tag IN ('O', 'P') AND additional_info = '1-URGENT')
    GROUP BY 1""")
def series_forms(spark, sf):
    """A series is a name, or an object with one tag or a list, and an info filter."""
    forms = ["orders", {"id": "orders", "tags": "F"}, {"id": "orders", "tags": ["O", "P"], "additional_info_filter": "1-URGENT"}]
    rows = series_frame({"orders": order(spark, sf)}, [SeriesSpec.parse(f) for f in forms])
    return rows.groupBy("series_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"""SELECT e.tag AS state, e.value AS price, row_number() OVER (ORDER BY e.tag, e."timestamp", e.event_id) AS idx FROM {USER} e
    JOIN (SELECT name, tag, max("timestamp") AS newest FROM {USER} WHERE name = 'user_view' GROUP BY ALL) m
    ON e.name = m.name AND e.tag = m.tag AND e."timestamp" = m.newest""")
def latest_per_tag_unsliced(spark, sf):
    """Without a limit a latest-per-tag table is numbered by tag as well."""
    view = {
        "id": "counters",
        "data": [{"id": "newest", "event": "user_view", "last_unique_by_tag": True}],
        "widgets": [
            {
                "title": "Newest",
                "type": "table",
                "data_sources": ["newest"],
                "table_columns": [
                    {"title": "state", "event_field": "tag"},
                    {"title": "price", "event_field": "value"},
                    {"title": "idx", "event_field": "index"},
                ],
            }
        ],
    }
    return run_view(user(spark, sf), view, APP_NOW).widgets["Newest"].select("state", "price", "idx")


@query(f"""SELECT tag, count(*) FILTER (value = 7) AS equal_number, count(*) FILTER (value <> 7) AS other_number,
        count(*) FILTER (contains(CAST(CAST(value AS BIGINT) AS VARCHAR), '5')) AS with_five,
        count(*) FILTER (tag = 'N') AS tag_is_n, count(*) FILTER (tag <> 'N') AS tag_not_n,
        count(*) FILTER (value > 20.5) AS above, count(*) FILTER (value < 20) AS below,
        CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS padded FROM {SHIP} GROUP BY tag""")
def row_conditions(spark, sf):
    value, tag = F.col("value"), F.col("tag")
    return ship(spark, sf).groupBy("tag").agg(
        F.count_if(evaluate(value, "equals", "7", numeric=True)).alias("equal_number"),
        F.count_if(evaluate(value, "not_equals", 7, numeric=True)).alias("other_number"),
        F.count_if(evaluate(value, "contains", 5, numeric=True)).alias("with_five"),
        F.count_if(evaluate(tag, "equals", "N")).alias("tag_is_n"),
        F.count_if(evaluate(tag, "not_equals", "N")).alias("tag_not_n"),
        F.count_if(evaluate(value, "greater_than", "20.5", numeric=True)).alias("above"),
        F.count_if(evaluate(value, "less_than", 20, numeric=True)).alias("below"),
        F.count_if(evaluate(value, "resembles", 20, numeric=True)).alias("unknown"),
        F.count_if(evaluate(value, "equals", "7.0", numeric=True)).alias("padded"),
    )


@query(f"""SELECT e.tag AS state, e.value AS price, {TIME_TEXT.replace('"timestamp"', 'e."timestamp"')} AS "at", '' AS row_class,
        row_number() OVER (ORDER BY e.tag, e."timestamp", e.event_id) AS row_position
    FROM {ORDER} e JOIN (SELECT tag, max("timestamp") AS newest FROM {ORDER} GROUP BY tag) m
    ON e.tag = m.tag AND e."timestamp" = m.newest ORDER BY 5 LIMIT 100""")
def latest_per_tag_table(spark, sf):
    view = {
        "id": "counters",
        "data": [{"id": "newest", "event": "order", "last_unique_by_tag": True}],
        "widgets": [
            {
                "title": "Newest",
                "type": "table",
                "data_sources": ["newest"],
                "max_rows": 100,
                "table_columns": [
                    {"title": "state", "event_field": "tag"},
                    {"title": "price", "event_field": "value"},
                    {"title": "at", "event_field": "time"},
                ],
            }
        ],
    }
    return run_view(order(spark, sf), view, ORDER_NOW).widgets["Newest"]


@query(f"""SELECT s.series_idx, s."timestamp", v.value FROM (SELECT i.series_idx, t."timestamp" FROM
        (SELECT unnest(generate_series(TIMESTAMP '2001-07-02 00:00:00', TIMESTAMP '2001-08-02 00:00:00', INTERVAL '7 days'))
        AS "timestamp") t, (VALUES (0), (1)) i(series_idx)) s LEFT JOIN
    (SELECT CASE WHEN additional_info = '1-URGENT' THEN 0 ELSE 1 END AS series_idx,
        CAST(date_trunc('week', "timestamp") AS TIMESTAMP) AS b, max(value) AS value FROM {ORDER}
        WHERE additional_info IN ('1-URGENT', '5-LOW') AND "timestamp" >= TIMESTAMP '2001-07-03 00:00:00' GROUP BY 1, 2) v
    ON s.series_idx = v.series_idx AND s."timestamp" = v.b""")
def view_info_series(spark, sf):
    """Series split by info text, with the event name and the interval chosen by the caller."""
    view = {
        "id": "orders",
        "default_event_name_param": "order",
        "event_name_param_choices": [{"value": "order", "label": "Orders"}],
        "data": [{"id": "picked", "event": "{event_name_param}", "max_age_days": 30}],
        "widgets": [
            {
                "title": "Largest",
                "type": "line_graph",
                "data_sources": [
                    {"id": "picked", "additional_info_filter": "1-URGENT"},
                    {"id": "picked", "additional_info_filter": ["5-LOW"]},
                ],
                "time_aggregation": {"aggregation_function": "max"},
            }
        ],
    }
    return run_view(order(spark, sf), view, ORDER_NOW, intervals={"Largest": "week"}).widgets["Largest"]
