"""Config parsing: defaults, resolution and rejection."""

from __future__ import annotations

from datetime import datetime

import pytest
from helpers import events, optimized, plan, values
from pyspark.sql import functions as F

from catalog.base import app
from tickloom.functions.mutators import apply_mutators
from tickloom.plans.specs import SeriesSpec, SourceSpec, TimeAggregation, ViewSpec, WidgetSpec
from tickloom.plans.view import run_view


def test_source_defaults():
    source = SourceSpec.parse({"id": "s", "event": "e", "tags": None})
    assert (source.max_age_days, source.max_results, source.tags, source.last_unique_by_tag) == (0, 0, (), False)
    assert SourceSpec.parse({"id": "s", "event": "e", "max_results": 7, "max_age_days": 2}).max_results == 7
    for broken in ({"id": "s"}, {"event": "e"}):
        with pytest.raises(ValueError):
            SourceSpec.parse(broken)


def test_event_name_slot_is_filled_once():
    source = SourceSpec.parse({"id": "s", "event": "{event_name_param}/{event_name_param}"})
    assert source.event_name({"event_name_param": "x"}) == "x/{event_name_param}"
    assert source.event_name() == "/{event_name_param}"


def test_series_forms():
    assert SeriesSpec.parse("s") == SeriesSpec("s")
    one = SeriesSpec.parse({"id": "s", "tags": "t", "additional_info_filter": "i"})
    assert (one.tags, one.additional_info_filter, one.label) == (("t",), ("i",), "s [t]")
    assert SeriesSpec.parse({"id": "s", "tags": ["a", "b"]}).label == "s [a, b]"
    for broken in (5, {}, {"tags": ["t"]}, None):
        with pytest.raises(ValueError):
            SeriesSpec.parse(broken)


def test_mutator_checks(spark):
    for broken in ([{"operation": "square"}], [{"operation": "add"}], [{"operation": "add", "value": "x"}], [{}]):
        with pytest.raises(ValueError):
            SeriesSpec.parse({"id": "s", "mutators": broken})
        with pytest.raises(ValueError):
            apply_mutators(events(spark, []), broken)


def test_interval_resolution():
    free = TimeAggregation.parse({})
    assert (free.function, free.interval(), free.interval(None, "day")) == ("sum", "disabled", "day")
    assert free.interval("hour", "day") == "hour"
    assert free.interval("page_default", "page_default") == "disabled"
    fixed = TimeAggregation.parse({"starting_value": "week", "allow_selection": False})
    assert fixed.interval(None, "day") == "week"
    with pytest.raises(ValueError):
        fixed.interval("day")
    narrow = TimeAggregation.parse({"starting_value": "day", "choices": ["day", "week"]})
    assert narrow.interval("week") == "week"
    with pytest.raises(ValueError):
        narrow.interval("hour")
    for broken in ({"starting_value": "5m"}, {"choices": ["fortnight"]}, {"aggregation_function": "median"}):
        with pytest.raises(ValueError):
            TimeAggregation.parse(broken)


def test_widget_checks():
    for broken in (
        {"type": "radar", "data_sources": ["s"]},
        {"type": "counter", "data_sources": ["s", "t"], "counter_type": "sum"},
        {"type": "counter", "data_sources": ["s"], "counter_type": "median"},
        {"type": "gauge", "data_sources": []},
        {"type": "gauge", "data_sources": ["s"], "aggregation_type": "last_datetime"},
        {"type": "pie_chart", "data_sources": ["s"], "style": {"aggregation_type": "median"}},
    ):
        with pytest.raises(ValueError):
            WidgetSpec.parse(broken)
    assert WidgetSpec.parse({"type": "gauge", "data_sources": ["s"]}).aggregate == "last"
    assert WidgetSpec.parse({"type": "pie_chart", "data_sources": ["s"]}).aggregate == "sum"


def test_view_checks():
    with pytest.raises(ValueError):
        ViewSpec.parse({"widgets": []})
    view = ViewSpec.parse({"id": "v", "default_event_name_param": "e", "event_name_param_choices": [{"value": "e"}, "f"]})
    assert view.event_name_param_choices == ("e", "f")
    assert view.params() == {"event_name_param": "e"}
    assert view.params({"event_name_param": "f"}) == {"event_name_param": "f"}


ROWS = [
    (1, "cpu", 10.0, "a", None, "2024-01-01T10:00:00"),
    (2, "cpu", 30.0, "b", None, "2024-01-02T10:00:00"),
    (3, "cpu", 20.0, None, None, "2024-01-02T11:00:00"),
    (4, "mem", 1.0, "a", None, "2024-01-02T11:00:00"),
]
NOW = datetime(2024, 1, 3)


def view(*widgets, **source):
    return {"id": "v", "data": [{"id": "cpu", "event": "cpu", **source}], "widgets": list(widgets)}


def test_shared_sources(spark):
    counters = [{"type": "counter", "title": "c", "data_sources": ["cpu"], "counter_type": "max"}] * 2
    for share in (False, True):
        result = run_view(events(spark, ROWS), view(*counters), NOW, share=share)
        assert list(result.widgets) == ["c", "c (2)"]
        assert values(result.widgets["c (2)"], "value") == [(30.0,)]
        assert ("FileScan" in plan(result.widgets["c"])) is share


def test_a_source_covers_everything_unless_limited(spark):
    old = [(i, "cpu", 1.0, "a", None, f"20{i % 24:02d}-01-01T00:00:00") for i in range(1500)]
    counter = {"type": "counter", "title": "c", "data_sources": ["cpu"], "counter_type": "count"}
    table = {"type": "table", "title": "t", "data_sources": ["cpu"], "table_columns": [{"title": "#", "event_field": "index"}]}
    result = run_view(events(spark, old), view(counter, table), NOW)
    assert result.widgets["c"].first().value == 1500 and result.widgets["t"].count() == 1500


def test_the_summary_reads_a_source_once(spark, sf_dir):
    widgets = [{"type": "counter", "title": f"c{i}", "data_sources": [{"id": "cpu", "tags": [t]}], "counter_type": "max"} for i, t in enumerate(("click", "view"))]
    widgets.append({"type": "line_graph", "title": "l", "data_sources": ["cpu"], "time_aggregation": {"starting_value": "day"}})
    page = {"id": "v", "data": [{"id": "cpu", "event": "app_event"}], "widgets": widgets}
    summary = run_view(app(spark, sf_dir), page, NOW).summary()
    assert optimized(summary).count("Relation [") == 1
    frame = app(spark, sf_dir)
    days = frame.select(F.to_date("timestamp")).distinct().count()
    expected = {f"c{i}": frame.where(F.col("tag") == t).count() for i, t in enumerate(("click", "view"))} | {"l": days}
    assert {r.title: r.n_rows for r in summary.collect()} == expected


def test_row_cap_and_age_shape_the_numbers(spark):
    counter = {"type": "counter", "title": "c", "data_sources": ["cpu"], "counter_type": "sum"}
    sums = {
        k: values(run_view(events(spark, ROWS), view(counter, **source), NOW).widgets["c"], "value")
        for k, source in {"all": {}, "last": {"max_results": 1}, "day": {"max_age_days": 1}, "none": {"tags": ["z"]}}.items()
    }
    assert sums == {"all": [(60.0,)], "last": [(20.0,)], "day": [(50.0,)], "none": []}


def test_gauge_takes_a_time_aggregation(spark):
    gauge = {
        "type": "gauge",
        "title": "g",
        "data_sources": ["cpu"],
        "aggregation_type": "last",
        "time_aggregation": {"starting_value": "day", "aggregation_function": "sum"},
    }
    result = run_view(events(spark, ROWS), view(gauge), NOW).widgets["g"]
    assert result.columns == ["value", "zone"]
    assert result.first().value == 50.0


def test_empty_sources(spark):
    widgets = [
        {"type": "counter", "title": "c", "data_sources": ["cpu"], "counter_type": "count"},
        {"type": "pie_chart", "title": "p", "data_sources": ["cpu", {"id": "cpu", "tags": ["a"]}]},
        {"type": "table", "title": "t", "data_sources": ["cpu"], "table_columns": [{"title": "#", "event_field": "index"}]},
        {"type": "line_graph", "title": "l", "data_sources": ["cpu"], "time_aggregation": {"starting_value": "day"}},
        {"type": "scatter_map", "title": "s", "data_sources": ["cpu"]},
    ]
    result = run_view(events(spark, []), view(*widgets, max_age_days=2), NOW)
    assert [result.widgets[t].count() for t in "cpts"] == [0, 2, 0, 0]
    assert [(r.value, r.total, r.share) for r in result.widgets["p"].collect()] == [(0.0, 0.0, None)] * 2
    assert [r.value for r in result.widgets["l"].collect()] == [None] * 3
    assert all(r.is_empty for r in result.summary().collect())
