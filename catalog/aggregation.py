"""Scalar aggregates and mutators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    APP,
    ORDER,
    SHIP,
    USER,
    app,
    mean_sql,
    order,
    query,
    ship,
    user,
    whole_mean_sql,
)
from tickloom.functions.aggregates import SCALAR_KINDS, aggregate
from tickloom.functions.mutators import apply_mutators, mutate_value
from tickloom.operators import retrieve
from tickloom.operators.series import mutate_series, series_frame
from tickloom.operators.timeseries import interval_aggregate
from tickloom.plans.specs import SeriesSpec

VALUE_KINDS = [k for k in SCALAR_KINDS if not k.endswith("datetime")]


def _scalars(df, keys, kinds):
    rounded = [F.round(aggregate(k).cast("double"), 2 if k == "sum" else 4).alias(k) for k in kinds]
    return df.groupBy(*keys).agg(*rounded)


def _scalars_sql(source: str, key: str) -> str:
    return f"""SELECT {key},
        round(last(value ORDER BY "timestamp", event_id), 4) AS "last",
        round(first(value ORDER BY "timestamp", event_id), 4) AS "first",
        {mean_sql("avg(value)")} AS average, {whole_mean_sql("avg(value)")} AS average_round,
        round(sum(value), 2) AS "sum", round(max(value), 4) AS "max", round(min(value), 4) AS "min",
        CAST(count(*) AS DOUBLE) AS "count",
        round(last(value ORDER BY "timestamp", event_id) - first(value ORDER BY "timestamp", event_id), 4)
            AS diff_last_first,
        round(max(value) - min(value), 4) AS diff_max_min
        FROM {source} GROUP BY {key}"""


@query(_scalars_sql(USER, "name"))
def scalar_aggregates(spark, sf):
    return _scalars(user(spark, sf), ["name"], VALUE_KINDS)


@query(_scalars_sql(ORDER, "tag"))
def scalar_aggregates_ties(spark, sf):
    return _scalars(order(spark, sf), ["tag"], VALUE_KINDS)


@query(f"""SELECT name, min("timestamp") AS first_datetime, max("timestamp") AS last_datetime
    FROM {USER} GROUP BY name""")
def scalar_datetimes(spark, sf):
    kinds = ("first_datetime", "last_datetime")
    return user(spark, sf).groupBy("name").agg(*[aggregate(k).alias(k) for k in kinds])


@query(f"""SELECT tag, additional_info AS info, count(*) AS n, {mean_sql("avg(value)")} AS average, max(value) AS "max"
    FROM {SHIP} GROUP BY tag, additional_info""")
def shipment_aggregates(spark, sf):
    kinds = [aggregate("count").alias("n"), aggregate("average").alias("average"), aggregate("max").alias("max")]
    return ship(spark, sf).groupBy("tag", F.col("additional_info").alias("info")).agg(*kinds)


@query(f"""SELECT i AS series_idx, count(*) AS n, round(sum(value), 2) AS total FROM {APP} e
    JOIN (VALUES (0, 'error'), (1, 'error'), (1, 'purchase'), (3, 'view')) s(i, t) ON e.tag = s.t
    GROUP BY i UNION ALL SELECT 2, count(*), round(sum(value), 2) FROM {APP}""")
def series_fan_out(spark, sf):
    series = [
        SeriesSpec.parse({"id": "app", "tags": ["error"]}),
        SeriesSpec.parse({"id": "app", "tags": ["error", "purchase"]}),
        SeriesSpec.parse("app"),
        SeriesSpec.parse({"id": "app", "tags": "view"}),
    ]
    rows = series_frame({"app": app(spark, sf)}, series)
    return rows.groupBy("series_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""SELECT * FROM {ORDER} WHERE additional_info IN ('1-URGENT', '5-LOW')""")
def info_filter(spark, sf):
    return retrieve.with_info(order(spark, sf), ["1-URGENT", "5-LOW"])


@query(f"""SELECT * FROM {APP} WHERE "timestamp" >= TIMESTAMP '2024-01-10 00:00:00'
    AND "timestamp" < TIMESTAMP '2024-01-12 12:00:00'""")
def time_range(spark, sf):
    return retrieve.between(app(spark, sf), "2024-01-10", "2024-01-12T12:00:00")


@query(f"""SELECT event_id, value + 10 AS added, value - 2.5 AS subtracted, value * 3 AS multiplied,
    value / 4 AS divided, value AS divided_by_zero FROM {APP}""")
def mutators_arith(spark, sf):
    x = F.col("value")
    return app(spark, sf).select(
        "event_id",
        mutate_value(x, "add", 10.0).alias("added"),
        mutate_value(x, "subtract", 2.5).alias("subtracted"),
        mutate_value(x, "multiply", 3.0).alias("multiplied"),
        mutate_value(x, "divide", 4.0).alias("divided"),
        mutate_value(x, "divide", 0.0).alias("divided_by_zero"),
    )


@query(f"""SELECT event_id, floor(v + 0.5) AS rounded, floor(v) AS floored, ceil(v) + 0.0 AS ceiled, abs(v) AS magnitude,
    CASE WHEN v < 0 THEN 0.0 ELSE v END AS no_negatives FROM (SELECT event_id, value - 50 AS v FROM {APP})""")
def mutators_rounding(spark, sf):
    v = F.col("value") - 50
    return app(spark, sf).select(
        "event_id",
        mutate_value(v, "round").alias("rounded"),
        mutate_value(v, "floor").alias("floored"),
        mutate_value(v, "ceil").alias("ceiled"),
        mutate_value(v, "absolute").alias("magnitude"),
        mutate_value(v, "remove_negatives").alias("no_negatives"),
    )


@query(f"""SELECT event_id, tag, value - lag(value) OVER (PARTITION BY tag ORDER BY "timestamp", event_id) AS value
    FROM {ORDER}""")
def mutator_delta(spark, sf):
    changed = apply_mutators(order(spark, sf), [{"operation": "to_delta"}], ["tag"])
    return changed.select("event_id", "tag", "value")


@query(f"""SELECT event_id, tag, CASE WHEN p <> 0 THEN round((value - p) / abs(p) * 100, 4) + 0.0 END AS value FROM
    (SELECT *, lag(value) OVER (PARTITION BY tag ORDER BY "timestamp", event_id) AS p FROM
     (SELECT event_id, tag, "timestamp", CASE WHEN event_id % 7 = 0 THEN 0 ELSE value - 50 END AS value FROM {APP}))""")
def mutator_pct_change(spark, sf):
    signed = app(spark, sf).withColumn(
        "value", F.when(F.col("event_id") % 7 == 0, F.lit(0.0)).otherwise(F.col("value") - 50)
    )
    changed = apply_mutators(signed, [{"operation": "to_percentage_change"}], ["tag"])
    return changed.select("event_id", "tag", F.round("value", 4).alias("value"))


@query(f"""WITH hourly AS (SELECT tag, CAST(date_trunc('hour', "timestamp") AS TIMESTAMP) AS "timestamp",
        {mean_sql("avg(value)")} AS v FROM {APP} WHERE tag IN ('click', 'view') GROUP BY 1, 2),
    scaled AS (SELECT *, v * 100 - 5 AS s FROM hourly),
    delta AS (SELECT *, s - lag(s) OVER (PARTITION BY tag ORDER BY "timestamp") AS d FROM scaled)
    SELECT CASE WHEN tag = 'click' THEN 0 ELSE 1 END AS series_idx, "timestamp",
        round(abs(floor(d + 0.5)) / 2, 4) AS value FROM delta""")
def mutator_chain(spark, sf):
    chain = [
        {"operation": "multiply", "value": 100},
        {"operation": "subtract", "value": 5},
        {"operation": "to_delta"},
        {"operation": "round"},
        {"operation": "absolute"},
        {"operation": "divide", "value": 2},
    ]
    series = [SeriesSpec.parse({"id": "app", "tags": [t], "mutators": chain}) for t in ("click", "view")]
    hourly = interval_aggregate(series_frame({"app": app(spark, sf)}, series), "hour", "average")
    changed = mutate_series(hourly, series, tie=None, bounded=True)
    return changed.select("series_idx", "timestamp", F.round("value", 4).alias("value"))


@query(f"""SELECT 0 AS series_idx, event_id, value * 2 AS value FROM {APP} WHERE tag = 'error'
    UNION ALL SELECT 1, event_id, value - lag(value) OVER (ORDER BY "timestamp", event_id) FROM {APP}
    WHERE tag IN ('purchase', 'signup') UNION ALL SELECT 2, event_id, value FROM {APP}""")
def mutators_per_series(spark, sf):
    series = [
        SeriesSpec.parse({"id": "app", "tags": ["error"], "mutators": [{"operation": "multiply", "value": "2"}]}),
        SeriesSpec.parse({"id": "app", "tags": ["purchase", "signup"], "mutators": [{"operation": "to_delta"}]}),
        SeriesSpec.parse("app"),
    ]
    changed = mutate_series(series_frame({"app": app(spark, sf)}, series), series)
    return changed.select("series_idx", "event_id", "value")
