"""Run a view: every source once, every widget from the sources it names."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.aggregates import aggregate
from tickloom.functions.buckets import bucket
from tickloom.model import EVENT_COLUMNS, Instant
from tickloom.operators import charts, rollup, tables
from tickloom.operators.retrieve import between, within
from tickloom.operators.series import belongs, mutate_series, series_frame
from tickloom.operators.timeseries import interval_aggregate, oldest_max_age
from tickloom.plans.specs import SourceSpec, ViewSpec, WidgetSpec
from tickloom.session import stored
from tickloom.sources.rollups import Rollup


@dataclass
class ViewResult:
    """Widget results and the events behind them, by widget title.

    `choices` holds the choices of table filters by (widget title, column title).
    """

    view_id: str
    widgets: dict[str, DataFrame] = field(default_factory=dict)
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    choices: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    _uses: dict[str, list[tuple[str, int, Column, str]]] = field(default_factory=dict)
    _sources: dict[str, DataFrame] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """Rows behind every widget and whether it has any.

        Every source is read once: its rows are dealt to all widgets that use
        them and counted together. Mutators leave the number of rows as it is;
        a bucketed widget counts buckets.
        """
        if not self.types:
            raise ValueError(f"view {self.view_id!r} has no widget with data")
        parts = []
        for sid, uses in self._uses.items():
            marks = [
                F.when(
                    holds,
                    F.struct(
                        F.lit(title).alias("title"),
                        F.lit(idx).alias("series_idx"),
                        F.lit(interval != "disabled").alias("bucketed"),
                        (F.lit(None).cast("timestamp") if interval == "disabled" else bucket("timestamp", interval)).alias("start"),
                    ),
                )
                for title, idx, holds, interval in uses
            ]
            dealt = self._sources[sid].select("name", F.explode(F.array(*marks)).alias("use")).where(F.col("use").isNotNull())
            counted = dealt.groupBy("use", "name").agg(F.count(F.lit(1)).alias("n"))
            rows = F.sum(F.when(F.col("use.bucketed"), 1).otherwise(F.col("n"))).alias("n")
            parts.append(counted.groupBy(F.col("use.title").alias("title")).agg(rows))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("title").agg(F.sum("n").alias("n"))
        listed = found.sparkSession.createDataFrame(list(self.types.items()), "title string, type string")
        n_rows = F.coalesce("n", F.lit(0)).cast("long")
        return listed.join(found, "title", "left").select(
            F.lit(self.view_id).alias("view_id"), "title", "type", n_rows.alias("n_rows"), (n_rows == 0).alias("is_empty")
        )


def widget_input(
    widget: WidgetSpec,
    sources: Mapping[str, DataFrame],
    specs: Mapping[str, SourceSpec],
    interval: str,
    time_range: tuple[Instant | None, Instant | None] | None = None,
) -> DataFrame:
    """Series events of a widget: filtered, bucketed, then mutated."""
    frame = series_frame(sources, widget.series)
    if time_range and widget.time_range_filter:
        frame = between(frame, *time_range)
    bucketed = interval != "disabled"
    if bucketed:
        frame = _bucket_rows(interval_aggregate(frame, interval, _bucket_function(widget)))
    return mutate_series(frame, widget.series, tie="event_id", bounded=bucketed)


def _bucket_function(widget: WidgetSpec) -> str:
    return widget.time_aggregation.function if widget.time_aggregation else "sum"


def _bucket_rows(buckets: DataFrame) -> DataFrame:
    """Interval values in the columns of events."""
    missing = F.lit(None).cast("string")
    event_id = F.lit(0).cast("long").alias("event_id")
    return buckets.select("series_idx", event_id, "name", "value", missing.alias("tag"), missing.alias("additional_info"), "timestamp")


def rollup_input(widget: WidgetSpec, sources: Mapping[str, DataFrame], interval: str) -> DataFrame:
    """What `widget_input` gives, from the partials of the sources: interval values, or partials of undivided series."""
    frame = series_frame(sources, widget.series)
    if interval == "disabled":
        return frame
    buckets = rollup.interval_values(frame, interval, _bucket_function(widget))
    return mutate_series(_bucket_rows(buckets), widget.series, tie="event_id", bounded=True)


def widget_result(
    widget: WidgetSpec,
    frame: DataFrame,
    specs: Mapping[str, SourceSpec],
    interval: str,
    as_of: datetime,
    selected: Mapping[str, list[object]] | None = None,
    expression: charts.Aggregate = aggregate,
) -> DataFrame:
    """Shape a widget's input the way its type asks for."""
    style = widget.style
    if widget.type == "counter":
        return charts.counter(frame, widget.aggregate, expression)
    if widget.type == "gauge":
        low, high = (d if style.get(k) is None else style[k] for k, d in (("min", 0), ("max", 100)))
        reading = charts.gauge(frame, widget.aggregate, style.get("axis_colors"), low, high, expression)
        return reading if widget.config.get("show_last_value_time") else reading.drop("last_time")
    if widget.type == "pie_chart":
        given = style.get("labels") or []
        labels = [
            given[i] if i < len(given) and given[i] else s.label for i, s in enumerate(widget.series)
        ]
        return charts.pie(frame, labels, widget.aggregate, expression)
    if widget.type in ("line_graph", "bar_graph"):
        age = oldest_max_age([specs[s.id].max_age_days for s in widget.series])
        default = None if widget.type == "line_graph" else 0.0
        return charts.time_chart(frame, interval, as_of, age, range(len(widget.series)), default)
    if widget.type == "scatter_map":
        return charts.scatter(frame)
    rows = table_rows(widget, frame, specs)
    max_rows = widget.config.get("max_rows")
    return tables.table(
        rows,
        widget.config["table_columns"],
        max_rows,
        widget.config.get("slice_from") or "start",
        widget.config.get("color_rules") or (),
        selected,
    )


def table_rows(widget: WidgetSpec, frame: DataFrame, specs: Mapping[str, SourceSpec]) -> DataFrame:
    """Input of a table with the columns that order it."""
    by_tag = F.lit(False)
    for i, s in enumerate(widget.series):
        if specs[s.id].last_unique_by_tag:
            by_tag = by_tag | (F.col("series_idx") == i)
    return frame.withColumn("source_pos", F.col("series_idx")).withColumn("tag_place", F.when(by_tag, F.col("tag")))


def run_view(
    events: DataFrame,
    view: ViewSpec | Mapping[str, object],
    as_of: datetime,
    params: Mapping[str, str] | None = None,
    intervals: Mapping[str, str] | None = None,
    page_interval: str | None = None,
    time_range: tuple[Instant | None, Instant | None] | None = None,
    selected: Mapping[str, Mapping[str, list[object]]] | None = None,
    share: bool = False,
    kept: Rollup | None = None,
) -> ViewResult:
    """Plan every widget of a view.

    `intervals` and `selected` hold per-widget interval choices and table
    filter selections by title. With `share`, sources that feed several widgets
    are written to the shared scratch folder first, so that each is read from
    the events once however many widgets are run. Widgets naming a missing
    source are skipped. Widgets that kept partials can answer are answered from
    these, without a look at the events.
    """
    spec = view if isinstance(view, ViewSpec) else ViewSpec.parse(view)
    resolved = spec.params(params)
    specs = {s.id: s for s in spec.sources}
    uses = {sid: sum(sid in {s.id for s in w.series} for w in spec.widgets) for sid in specs}
    result = ViewResult(spec.id)
    frames = result._sources
    for sid, source in specs.items():
        if uses[sid] == 0:
            continue
        frames[sid] = source.to_df(events, as_of, resolved).select(*EVENT_COLUMNS)
        if share and uses[sid] > 1:
            frames[sid] = stored(frames[sid], "view-source")
    sums = {}
    if kept is not None:
        sums = {sid: rollup.source_partials(kept.kept, kept.events, specs[sid], specs[sid].event_name(resolved), as_of) for sid in frames}

    for widget in spec.widgets:
        if not widget.series or any(s.id not in frames for s in widget.series):
            continue
        title, n = widget.title, 2
        while title in result.widgets:
            title, n = f"{widget.title} ({n})", n + 1
        interval = "disabled"
        if widget.time_aggregation:
            default = page_interval or spec.default_time_aggregation
            interval = widget.time_aggregation.interval((intervals or {}).get(title), default)
        ranged = bool(time_range and widget.time_range_filter)
        from_sums = kept is not None and rollup.answers(widget, specs, interval, ranged)
        frame = rollup_input(widget, sums, interval) if from_sums else widget_input(widget, frames, specs, interval, time_range)
        in_range = F.lit(True)
        if time_range and widget.time_range_filter:
            in_range = within(*time_range)
        for idx, s in enumerate(widget.series):
            test = belongs(s)
            result._uses.setdefault(s.id, []).append((title, idx, in_range if test is None else test & in_range, interval))
        result.types[title] = widget.type
        result.inputs[title] = frame
        titles = tables.fields_by_title(widget.config.get("table_columns") or ())
        for each in widget.config.get("filters") or () if widget.type == "table" else ():
            if each["field"] in titles:
                rows = table_rows(widget, frame, specs)
                offered = tables.filter_choices(rows, titles[each["field"]], each.get("choices"))
                result.choices[title, each["field"]] = offered
        result.widgets[title] = widget_result(
            widget, frame, specs, interval, as_of, (selected or {}).get(title),
            rollup.merged if from_sums and interval == "disabled" else aggregate,
        )
    return result
