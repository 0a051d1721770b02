"""Interval aggregation, axes and gap filling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import (
    APP,
    APP_NOW,
    ORDER,
    ORDER_NOW,
    SHIP,
    app,
    bucket_sql,
    mean_sql,
    order,
    query,
    ship,
    whole_mean_sql,
)
from tickloom.functions.aggregates import BUCKET_KINDS
from tickloom.operators import charts
from tickloom.operators.series import series_frame
from tickloom.operators.timeseries import (
    combine_on_axis,
    fixed_step_slot,
    interval_aggregate,
    interval_table,
    raw_points,
)
from tickloom.plans.specs import SeriesSpec

APP_SERIES = [
    SeriesSpec.parse({"id": "app", "tags": ["error"]}),
    SeriesSpec.parse({"id": "app", "tags": ["purchase", "signup"]}),
]
APP_SERIES_SQL = f"""(SELECT 0 AS series_idx, * FROM {APP} WHERE tag = 'error' UNION ALL
    SELECT 1, * FROM {APP} WHERE tag IN ('purchase', 'signup'))"""


def _interval_sql(source: str, interval: str) -> str:
    return f"""SELECT name, tag, {bucket_sql(interval)} AS "timestamp", round(sum(value), 2) AS "sum",
        {mean_sql("avg(value)")} AS average, {whole_mean_sql("avg(value)")} AS average_round, max(value) AS "max",
        min(value) AS "min", CAST(count(*) AS DOUBLE) AS "count", count(*) AS n
        FROM {source} GROUP BY 1, 2, 3"""


def _intervals(df, interval):
    table = interval_table(df, interval, {kind: kind for kind in BUCKET_KINDS}, ["name", "tag"])
    return table.withColumn("sum", F.round("sum", 2))


@query(_interval_sql(APP, "10m"))
def interval_10m(spark, sf):
    return _intervals(app(spark, sf), "10m")


@query(_interval_sql(APP, "30m"))
def interval_30m(spark, sf):
    return _intervals(app(spark, sf), "30m")


@query(_interval_sql(APP, "hour"))
def interval_hour(spark, sf):
    return _intervals(app(spark, sf), "hour")


@query(_interval_sql(APP, "day"))
def interval_day(spark, sf):
    return _intervals(app(spark, sf), "day")


@query(_interval_sql(SHIP, "week"))
def interval_week(spark, sf):
    return _intervals(ship(spark, sf), "week")


@query(_interval_sql(ORDER, "month"))
def interval_month(spark, sf):
    return _intervals(order(spark, sf), "month")


@query(_interval_sql(SHIP, "year"))
def interval_year(spark, sf):
    return _intervals(ship(spark, sf), "year")


@query(f"""SELECT series_idx, name, {bucket_sql("hour")} AS "timestamp", {mean_sql("avg(value)")} AS value, count(*) AS n
    FROM {APP_SERIES_SQL} GROUP BY 1, 2, 3 ORDER BY 1, 3""")
def hourly_average(spark, sf):
    """The flagship: hourly means of two tag groups, in time order."""
    rows = series_frame({"app": app(spark, sf)}, APP_SERIES)
    return interval_aggregate(rows, "hour", "average").orderBy("series_idx", "timestamp")


@query(f"SELECT series_idx, event_id, value FROM {APP_SERIES_SQL}")
def interval_disabled(spark, sf):
    rows = series_frame({"app": app(spark, sf)}, APP_SERIES)
    return interval_aggregate(rows, "disabled", "sum").select("series_idx", "event_id", "value")


def _axis_sql(values: str, start: str, end: str, step: str, n: int, value: str) -> str:
    return f"""SELECT s.series_idx, s."timestamp", {value} AS value
        FROM (SELECT i.series_idx, t."timestamp" FROM (SELECT unnest(generate_series({start}, {end}, INTERVAL {step}))
            AS "timestamp") t, (SELECT unnest(range({n})) AS series_idx) i) s
        LEFT JOIN ({values}) v ON s.series_idx = v.series_idx AND s."timestamp" = v.b"""


@query(
    _axis_sql(
        f"SELECT series_idx, {bucket_sql('10m')} AS b, {mean_sql("avg(value)")} AS value FROM {APP_SERIES_SQL} GROUP BY 1, 2",
        "TIMESTAMP '2024-01-01 00:00:00'",
        "TIMESTAMP '2024-01-31 00:00:00'",
        "'10 minutes'",
        2,
        "v.value",
    )
)
def line_gap_fill(spark, sf):
    values = interval_aggregate(series_frame({"app": app(spark, sf)}, APP_SERIES), "10m", "average")
    return charts.time_chart(values, "10m", APP_NOW, 30, range(2), None)


@query(
    _axis_sql(
        f"""SELECT 0 AS series_idx, CAST(date_trunc('day', "timestamp") AS TIMESTAMP) AS b, CAST(count(*) AS DOUBLE) AS value
            FROM {ORDER} WHERE tag = 'P' GROUP BY 1, 2""",
        "TIMESTAMP '1994-12-22 00:00:00'",
        "TIMESTAMP '2001-08-02 00:00:00'",
        "'1 day'",
        1,
        "coalesce(v.value, 0)",
    )
)
def bar_gap_fill(spark, sf):
    series = [SeriesSpec.parse({"id": "orders", "tags": ["P"]})]
    values = interval_aggregate(series_frame({"orders": order(spark, sf)}, series), "day", "count")
    return charts.time_chart(values, "day", ORDER_NOW, 2415, range(1), 0.0)


@query(
    _axis_sql(
        f"""SELECT 0 AS series_idx, CAST(date_trunc('month', "timestamp") AS TIMESTAMP) AS b, max(value) AS value
            FROM {ORDER} GROUP BY 1, 2""",
        f"""(SELECT CAST(date_trunc('month', min("timestamp")) AS TIMESTAMP) FROM {ORDER})""",
        "TIMESTAMP '2001-08-02 00:00:00'",
        "'1 month'",
        2,
        "v.value",
    )
)
def empty_series_spine(spark, sf):
    series = [SeriesSpec.parse("orders"), SeriesSpec.parse({"id": "orders", "tags": ["none such"]})]
    values = interval_aggregate(series_frame({"orders": order(spark, sf)}, series), "month", "max")
    return charts.time_chart(values, "month", ORDER_NOW, None, range(2), None)


_FOLDED = f"""SELECT series_idx, least(b, TIMESTAMP '2024-01-20 00:00:00') AS b,
    round(sum(value * CASE WHEN i = 1 THEN pow(0.5, n - 1) ELSE pow(0.5, n - i + 1) END), 4) AS value
    FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_idx, least(b, TIMESTAMP '2024-01-20 00:00:00')) AS n
          FROM (SELECT series_idx, {bucket_sql("day")} AS b, {mean_sql("avg(value)")} AS value FROM {APP_SERIES_SQL} GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY series_idx, least(b, TIMESTAMP '2024-01-20 00:00:00') ORDER BY b))
    GROUP BY 1, 2"""


@query(
    _axis_sql(
        _FOLDED, "TIMESTAMP '2024-01-10 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'", "'1 day'", 2, "v.value"
    )
)
def axis_open_end(spark, sf):
    """Ten days before a moment inside the data: earlier values drop, later ones fold into the last bucket."""
    values = interval_aggregate(series_frame({"app": app(spark, sf)}, APP_SERIES), "day", "average")
    points = charts.time_chart(values, "day", datetime(2024, 1, 20), 10, range(2), None)
    return points.withColumn("value", F.round("value", 4))


_STEP_SLOT = """TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1 day' *
    (30 * CAST(floor(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', b) / 30) AS INTEGER))"""


@query(f"""SELECT 0 AS series_idx, slot, round(sum(value * CASE WHEN i = 1 THEN pow(0.5, n - 1)
        ELSE pow(0.5, n - i + 1) END), 4) AS value
    FROM (SELECT slot, value, row_number() OVER (PARTITION BY slot ORDER BY b) AS i, count(*) OVER (PARTITION BY slot) AS n
          FROM (SELECT *, {_STEP_SLOT} AS slot FROM
                (SELECT CAST(date_trunc('day', "timestamp") AS TIMESTAMP) AS b, {mean_sql("avg(value)")} AS value FROM {ORDER} GROUP BY 1)))
    GROUP BY slot""")
def axis_pairwise(spark, sf):
    series = [SeriesSpec.parse("orders")]
    values = interval_aggregate(series_frame({"orders": order(spark, sf)}, series), "day", "average")
    slot = fixed_step_slot(F.col("timestamp"), datetime(1995, 1, 1), 30)
    return combine_on_axis(values, slot).withColumn("value", F.round("value", 4))


@query(f"""SELECT series_idx, "timestamp", value FROM {APP_SERIES_SQL}""")
def raw_chart_points(spark, sf):
    return raw_points(series_frame({"app": app(spark, sf)}, APP_SERIES))
