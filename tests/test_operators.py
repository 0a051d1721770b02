"""Edge cases and properties of the batch operators."""

from __future__ import annotations

from datetime import datetime

import pytest
from helpers import at, events, optimized, plan, values
from pyspark.sql import functions as F

from catalog.base import app, order
from tickloom.functions.aggregates import BUCKET_KINDS, aggregate
from tickloom.functions.buckets import INTERVALS, bucket
from tickloom.functions.conditions import evaluate
from tickloom.functions.mutators import apply_mutators
from tickloom.functions.numbers import leading_number, number_text, round_half_up, steady_round
from tickloom.model import instant, micros, normalize_events
from tickloom.operators import charts, metrics, retrieve, tables
from tickloom.operators.series import series_frame
from tickloom.operators.timeseries import (
    combine_on_axis,
    fill_axis,
    interval_aggregate,
    oldest_max_age,
    time_spine,
)
from tickloom.plans.specs import SeriesSpec

NOW = datetime(2024, 1, 10)


def column(spark, data, kind="double"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i long, x {kind}").orderBy("i")


def computed(spark, data, make, kind="double"):
    rows = column(spark, data, kind).select("i", make(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_round_half_up(spark):
    data = [-2.5, -2.6, -0.5, 0.49999999999999994, 0.5, 2.5, 1e300, float(2**52 + 1), None]
    assert computed(spark, data, round_half_up) == [-2.0, -3.0, 0.0, 0.0, 1.0, 3.0, 1e300, float(2**52 + 1), None]


def test_steady_round_clears_summation_noise(spark):
    assert computed(spark, [38.37875, 38.378749999999997, -38.37875], lambda x: steady_round(x, 4)) == [
        38.3788,
        38.3788,
        -38.3788,
    ]


def test_number_text(spark):
    data = [5.0, -0.5, 1e7, 12345678.5, 0.00012, 1e17, 0.1]
    assert computed(spark, data, number_text) == [
        "5",
        "-0.5",
        "10000000",
        "12345678.5",
        "0.00012",
        "100000000000000000",
        "0.1",
    ]


def test_leading_number(spark):
    data = ["12ms", " -3.5e2x", ".5", "5.", "ms12", "", "e5", "Infinity", "1e", None]
    assert computed(spark, data, leading_number, "string") == [12.0, -350.0, 0.5, 5.0, None, None, None, float("inf"), 1.0, None]


def test_buckets_at_borders(spark):
    moments = ["2024-01-07T23:59:59.999999", "2024-01-08T00:00:00", "1969-12-31T23:55:00", "2024-02-29T12:34:56"]
    frame = spark.createDataFrame([(at(m),) for m in moments], "ts timestamp")
    got = {
        k: [str(r[0]) for r in frame.select(bucket("ts", k).cast("timestamp_ntz")).collect()] for k in INTERVALS
    }
    assert got["10m"] == ["2024-01-07 23:50:00", "2024-01-08 00:00:00", "1969-12-31 23:50:00", "2024-02-29 12:30:00"]
    assert got["30m"][3] == "2024-02-29 12:30:00"
    assert got["week"] == ["2024-01-01 00:00:00", "2024-01-08 00:00:00", "1969-12-29 00:00:00", "2024-02-26 00:00:00"]
    assert got["month"][0] == "2024-01-01 00:00:00" and got["year"][2] == "1969-01-01 00:00:00"
    with pytest.raises(ValueError):
        bucket("ts", "5m")


ROWS = [
    (1, "n", 5.0, "a", "x", "2024-01-01T00:00:00"),
    (2, "n", 7.0, "a", None, "2024-01-01T00:00:00"),
    (3, "n", -2.5, "b", "y", "2024-01-05T00:00:00"),
    (4, "n", 0.0, None, "", "2024-01-09T00:00:00"),
    (5, "m", 1.0, "a", "x", "2024-01-09T00:00:00"),
]


def test_get_events_edges(spark):
    frame = events(spark, ROWS)

    def ids(**kw):
        return [r.event_id for r in retrieve.get_events(frame, "n", as_of=NOW, **kw).collect()]

    assert ids() == ids(tags=[]) == [1, 2, 3, 4]
    assert ids(tags=["a", "b"]) == [1, 2, 3]
    assert ids(max_age_days=5) == [3, 4]
    assert ids(max_age_days=4.999) == [4]
    assert ids(max_results=2) == [3, 4]
    assert ids(max_results=3) == [2, 3, 4]
    with pytest.raises(ValueError):
        retrieve.get_events(frame, "n", max_age_days=1)


def test_latest_by_tag_ties(spark):
    frame = events(spark, ROWS)
    assert sorted(r.event_id for r in retrieve.latest_by_tag(frame, "n").collect()) == [1, 2, 3]
    assert sorted(r.event_id for r in retrieve.latest_by_tag(frame, "n", ties="one").collect()) == [2, 3]
    assert [r.event_id for r in retrieve.latest_by_tag(frame, "n", "b").collect()] == [3]
    assert [r.tag for r in retrieve.latest_by_tag(frame, "n").collect()] == ["a", "a", "b"]
    assert optimized(retrieve.latest_by_tag(app(spark, "/root/testdata/sf0.001"), "app_event", ties="one")).count("Relation [") == 1
    with pytest.raises(ValueError):
        retrieve.latest_by_tag(frame, "n", ties="some")


def test_any_id_breaks_ties(spark):
    big = 2**63 - 1
    rows = [(-big - 1, "n", 1.0, "t", None, "2024-01-01"), (big, "n", 2.0, "t", None, "2024-01-01")]
    rows += [(-big, "n", 3.0, "t", None, "2024-01-01T00:00:00.000001"), (None, "n", 4.0, "t", None, "2024-01-01T00:00:00.000002")]
    for n, last in ((2, 2.0), (3, 3.0), (4, 4.0)):
        got = events(spark, rows[:n]).agg(aggregate("last").alias("last"), aggregate("first").alias("first")).first()
        assert (got["last"], got["first"]) == (last, 1.0)


def test_normalize_checks(spark):
    with pytest.raises(ValueError):
        normalize_events(spark.range(1), {"nmae": "id"}, NOW)
    with pytest.raises(ValueError):
        normalize_events(spark.range(1), {"name": "id"}, NOW, value_mode="text")
    row = normalize_events(spark.range(1), {"name": F.lit("n")}, NOW).first()
    assert (row.name, row.value, row.tag, row.additional_info) == ("n", 0.0, None, None)


def test_instants():
    assert micros("2024-01-01T00:00:00") == micros(at("2024-01-01")) == micros("2024-01-01T02:00:00+02:00")
    assert micros("1969-12-31T23:59:59.999999") == -1


def test_unknown_kinds():
    with pytest.raises(ValueError):
        aggregate("median")
    with pytest.raises(ValueError):
        charts.time_chart(None, "fortnight", NOW, 1, [0], None)


@pytest.mark.parametrize("interval", ["10m", "day", "month"])
def test_bucket_sums_add_up(spark, sf_dir, interval):
    frame = app(spark, sf_dir)
    total, n = frame.agg(F.round(F.sum("value"), 2), F.count("*")).first()
    buckets = interval_aggregate(frame.withColumn("series_idx", F.lit(0)), interval, "sum")
    assert tuple(buckets.agg(F.round(F.sum("value"), 2), F.sum("n")).first()) == (total, n)


def test_disjoint_series_cover_everything(spark, sf_dir):
    series = [SeriesSpec.parse({"id": "s", "tags": [t]}) for t in ("click", "view", "error", "purchase", "signup")]
    frame = app(spark, sf_dir)
    assert series_frame({"s": frame}, series).count() == frame.count()


def test_spine_length(spark):
    empty = events(spark, []).withColumn("series_idx", F.lit(0))
    lengths = {k: time_spine(empty, k, NOW, 3, [0, 1]).count() for k in ("10m", "hour", "day", "week")}
    assert lengths == {"10m": 2 * (3 * 144 + 1), "hour": 2 * 73, "day": 8, "week": 4}
    assert time_spine(empty, "day", NOW, None, [0]).count() == 0
    assert time_spine(empty, "10m", NOW, 7000, [0]).count() == 7000 * 144 + 1
    old = events(spark, [(1, "n", 1.0, None, None, "2001-01-01T00:07:00")]).withColumn("series_idx", F.lit(0))
    points = time_spine(old, "30m", NOW, None, [0])
    assert points.count() == points.distinct().count() == (NOW - datetime(2001, 1, 1)).days * 48 + 1
    assert oldest_max_age([None, 0, 14, 30, -1]) == 30
    assert oldest_max_age([None, 0]) is None


def test_zero_stays_zero_on_lines(spark):
    frame = interval_aggregate(events(spark, ROWS).where("name = 'n'").withColumn("series_idx", F.lit(0)), "day", "sum")
    points = dict(values(fill_axis(frame, "day", NOW, 5, [0]), F.date_format("timestamp", "dd"), "value"))
    assert points == {"05": -2.5, "06": None, "07": None, "08": None, "09": 0.0, "10": None}


def test_pairwise_fold(spark):
    frame = events(spark, [(i, "n", v, None, None, f"2024-01-0{i}") for i, v in enumerate([8.0, 4.0, 2.0, 1.0], 1)])
    folded = combine_on_axis(frame.withColumn("series_idx", F.lit(0)), F.lit(at("2024-01-01")))
    assert [r.value for r in folded.collect()] == [((8 + 4) / 2 + 2) / 2 / 2 + 0.5]


def test_mutator_order_and_empty_input(spark):
    frame = events(spark, ROWS).where("name = 'n'")
    chain = [{"operation": "add", "value": 1}, {"operation": "multiply", "value": "2"}, {"operation": "to_delta"}]
    got = apply_mutators(frame, chain, ["name"], bounded=True)
    assert [r.value for r in got.orderBy("event_id").collect()] == [None, 4.0, -19.0, 5.0]
    assert apply_mutators(frame.limit(0), chain, ["name"]).count() == 0
    assert apply_mutators(frame, []).columns == frame.columns


def test_row_wise_chain_needs_no_window(spark):
    chain = [{"operation": o, "value": 2} for o in ("add", "multiply", "divide", "round", "absolute")]
    text = plan(apply_mutators(events(spark, ROWS), chain))
    assert "Window" not in text and "Exchange" not in text


CONDITIONS = [
    ("a", "equals", "a", True),
    (None, "equals", "null", True),
    (None, "not_equals", "a", True),
    ("12", "greater_than", 11.5, True),
    ("", "less_than", 1, True),
    (None, "less_than", 1, True),
    ("abc", "greater_than", 0, False),
    ("abc", "less_than", "x", False),
    ("abc", "contains", "bc", True),
    (None, "contains", "ul", True),
    ("a", "matches", "a", False),
]


def test_text_conditions(spark):
    for field, condition, wanted, holds in CONDITIONS:
        row = spark.createDataFrame([(field,)], "f string").select(evaluate(F.col("f"), condition, wanted)).first()
        assert row[0] is holds, (field, condition, wanted)


def test_table_edges(spark):
    rows = tables.union_sources([events(spark, ROWS)])
    columns = [{"title": t, "event_field": t} for t in tables.EVENT_FIELDS]
    end = tables.table(rows, columns, 2, "end").collect()
    assert sorted((r.row_position, r["index"], r.event_name) for r in end) == [(4, 4, "n"), (5, 5, "m")]
    assert {r.additional_info for r in end} == {"", "x"}
    assert tables.table(rows, columns, 100, "end").count() == 5
    assert tables.table(rows, columns, 100, selected={"tag": []}).count() == 0
    assert tables.table(rows, columns, 100, selected={"tag": ["a"], "value": [5]}).count() == 1
    assert tables.table(rows, columns, 100, selected={"no such title": ["a"]}).count() == 0
    with pytest.raises(ValueError):
        tables.table(rows, columns, 2, "middle")
    with pytest.raises(ValueError):
        tables.table(rows, [{"title": "t", "event_field": "name"}])


def test_filter_choices(spark):
    rows = tables.union_sources([events(spark, ROWS)])

    def texts(*args):
        return [r.choice for r in tables.filter_choices(rows, *args).collect()]

    assert texts("tag") == ["a", "b"]
    assert texts("additional_info") == ["x", "y"]
    assert texts("value") == ["-2.5", "0", "1", "5", "7"]
    assert texts("index") == ["1", "2", "3", "4", "5"]
    assert texts("tag", 1) == ["a"]
    assert texts("tag", ["z", 5.0]) == ["z", "5"]


def test_metric_helpers(spark):
    frame = spark.createDataFrame([(-1.5 * 1048576,), (1.9 * 1048576,)], "b double")
    assert values(frame, metrics.to_mb(F.col("b")), metrics.to_mb(F.col("b"), "floor")) == [(-1, -2), (1, 1)]
    tags = spark.createDataFrame([("cpu",), ("q,disk:0 C:",), ("odd,",)], "t string")
    assert values(tags, *metrics.split_tag(F.col("t"))) == [
        ("cpu", None, None),
        ("q", "disk", "0 C:"),
        ("odd", None, None),
    ]


def test_results_ignore_input_order(spark, sf_dir):
    frame = order(spark, sf_dir)
    shuffled = frame.repartition(13, "additional_info")
    for kind in BUCKET_KINDS:
        a = interval_aggregate(frame, "month", kind, ["tag"]).collect()
        b = interval_aggregate(shuffled, "month", kind, ["tag"]).collect()
        strip = [(r.tag, r.timestamp, round(r.value, 2), r.n) for r in a]
        assert sorted(strip) == sorted((r.tag, r.timestamp, round(r.value, 2), r.n) for r in b)


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(retrieve.get_events(app(spark, sf_dir), "app_event", ["error"], max_age_days=9, as_of=datetime(2024, 1, 31)))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "EqualTo(event_type,error)" in scan and "GreaterThanOrEqual(ts," in scan
    assert "user_id" not in scan.split("ReadSchema")[1]


def test_aggregates_are_hash_aggregates(spark, sf_dir):
    text = plan(order(spark, sf_dir).groupBy("tag").agg(aggregate("last"), aggregate("first"), aggregate("average")))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_latest_n_is_a_top_n(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(retrieve.latest(order(spark, sf_dir), 10))


def test_fan_out_scans_once(spark, sf_dir):
    series = [SeriesSpec.parse({"id": "s", "tags": [t]}) for t in ("click", "view", "error")]
    frame = interval_aggregate(series_frame({"s": app(spark, sf_dir)}, series), "hour", "average")
    text = optimized(frame)
    assert text.count("Relation [") == 1 and "Join" not in text


def test_instant_folds(spark, sf_dir):
    assert "timestamp_micros" not in optimized(app(spark, sf_dir).where(F.col("timestamp") > instant(NOW)))
