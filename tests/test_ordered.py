"""Order-dependent operators on skewed data, against plain Python."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from helpers import plan
from pyspark.sql import functions as F

from tickloom.functions.mutators import apply_mutators
from tickloom.operators.metrics import counter_rates
from tickloom.operators.ordered import number_rows, with_previous
from tickloom.operators.timeseries import combine_on_axis

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def skewed(spark, n=3000):
    """A key with two thirds of the rows, NULL keys, and a moment shared by a third of them."""
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else (None if i % 2 else f"k{i % 7}")
        moment = START + timedelta(hours=5) if i % 3 == 1 else START + timedelta(seconds=(i * 7919) % n)
        rows.append((i, key, float(i % 97) if i % 11 else None, moment))
    return spark.createDataFrame(rows, "event_id long, tag string, value double, timestamp timestamp").repartition(6)


@pytest.fixture(params=[1, 7])
def parts(spark, request):
    """How many ranges the rows are cut into."""
    settings = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("depth", [1, 3])
def test_previous_matches_plain_window(spark, parts, depth):
    frame = skewed(spark)
    got = with_previous(frame, ["value", "timestamp"], ["tag"], depth=depth)
    plain = with_previous(frame, ["value", "timestamp"], ["tag"], bounded=True, depth=depth)
    assert got.columns == plain.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_previous_without_keys(spark, parts):
    frame = skewed(spark)
    got = {r.event_id: r.prev_event_id for r in with_previous(frame, ["event_id"]).collect()}
    ordered = [r.event_id for r in frame.orderBy("timestamp", "event_id").collect()]
    assert got == dict(zip(ordered, [None, *ordered], strict=False))


def test_previous_behind_very_short_parts(spark, parts):
    """Parts with fewer rows than are looked back over."""
    frame = skewed(spark, 9)
    got = with_previous(frame, ["event_id"], depth=4)
    plain = with_previous(frame, ["event_id"], bounded=True, depth=4)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_a_large_key_spans_parts(spark, parts):
    text = plan(with_previous(skewed(spark), ["value"], ["tag"]))
    raw = [line for line in text.splitlines() if "Window [lag(value" in line]
    assert raw and all("_part" in line for line in raw)


def test_number_rows(spark, parts):
    frame = skewed(spark).withColumn("source_pos", F.col("event_id") % 2)
    order = ["source_pos", "tag", "timestamp", "event_id"]
    got = [r.event_id for r in number_rows(frame, order).orderBy("row_index").collect()]
    assert got == [r.event_id for r in frame.orderBy(*order).collect()]


def test_few_rows(spark, parts):
    frame = skewed(spark, 5)
    assert [r.row_index for r in number_rows(frame, ["event_id"]).orderBy("row_index").collect()] == [1, 2, 3, 4, 5]
    assert number_rows(frame.limit(0), ["event_id"]).count() == 0
    assert with_previous(frame, ["value"]).count() == 5
    assert with_previous(frame.limit(0), ["value"]).count() == 0


def test_a_chain_looks_back_once(spark):
    chain = [{"operation": o} for o in ("to_delta", "absolute", "to_delta", "to_percentage_change")]
    frame = skewed(spark)
    got = apply_mutators(frame, chain, ["tag"])
    assert plan(got).count("Window [lag(") == 1
    plain = apply_mutators(frame, chain, ["tag"], bounded=True)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_rates_of_a_reset_counter(spark):
    rows = [(1, 100.0, 0), (2, 160.0, 60), (3, 10.0, 120), (4, 11.0, 120), (5, 75.0, 150)]
    samples = spark.createDataFrame(
        [(i, "n", None, v, START + timedelta(seconds=s)) for i, v, s in rows],
        "event_id long, name string, tag string, value double, timestamp timestamp",
    )
    kept = {r.event_id: r.value for r in counter_rates(samples).collect()}
    assert kept == {2: 1, 3: -2, 4: None, 5: 2}
    nulled = {r.event_id: r.value for r in counter_rates(samples, on_reset="null").collect()}
    assert nulled == {2: 1, 3: None, 4: None, 5: 2}
    with pytest.raises(ValueError):
        counter_rates(samples, on_reset="drop")


def test_parts_find_the_rows_before_them_by_number(spark):
    """Two thousand parts of a row or two: no join of all parts with all parts."""
    settings = {"spark.sql.shuffle.partitions": "2000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    frame = skewed(spark, 3000)
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = with_previous(frame, ["value"], ["tag"], depth=2)
        assert "NestedLoop" not in plan(got) and "CartesianProduct" not in plan(got)
        for k, v in before.items():
            spark.conf.set(k, v)
        rows = sorted(map(repr, got.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == sorted(map(repr, with_previous(frame, ["value"], ["tag"], bounded=True, depth=2).collect()))


def test_pairwise_mean_of_a_slot_over_many_parts(spark, parts):
    frame = skewed(spark, 400).select(F.lit(0).alias("series_idx"), "timestamp", F.coalesce("value", F.lit(1.0)).alias("value"))
    frame = frame.groupBy("series_idx", "timestamp").agg(F.max("value").alias("value"))
    slot = F.when(F.second("timestamp") < 3, F.date_trunc("minute", "timestamp")).otherwise(F.lit(START))
    got = combine_on_axis(frame, slot)
    assert "collect_list" not in plan(got)
    want = combine_on_axis(frame, slot, bounded=True)
    rounded = lambda df: sorted(df.select("slot", F.round("value", 9)).collect())
    assert rounded(got) == rounded(want)
    assert combine_on_axis(frame.limit(0), slot).count() == 0
