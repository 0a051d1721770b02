"""Declarative configs: sources, series, widgets and views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from tickloom.functions.aggregates import BUCKET_KINDS, SCALAR_KINDS
from tickloom.functions.buckets import SELECTABLE
from tickloom.functions.mutators import check_mutators
from tickloom.operators import retrieve

# Names configs use.
EVENT_NAME_SLOT = "{event_name_param}"
DATA_WIDGETS = ("gauge", "line_graph", "bar_graph", "pie_chart", "counter", "table", "scatter_map")
WIDGETS = (*DATA_WIDGETS, "html_box")
SINGLE_SOURCE = ("gauge", "counter")


@dataclass(frozen=True)
class SourceSpec:
    """A named event query. It covers all events of its name; an age or a number
    of results limits it only where the config names one (0 means no limit)."""

    id: str
    event: str
    tags: tuple[str, ...] = ()
    max_age_days: float = 0
    max_results: int = 0
    last_unique_by_tag: bool = False

    @classmethod
    def parse(cls, config: Mapping[str, Any]) -> SourceSpec:
        for required in ("id", "event"):
            if not config.get(required):
                raise ValueError(f"source without {required!r}: {dict(config)}")

        return cls(
            id=config["id"],
            event=config["event"],
            tags=tuple(retrieve.tag_list(config.get("tags"))),
            max_age_days=config.get("max_age_days") or 0,
            max_results=config.get("max_results") or 0,
            last_unique_by_tag=bool(config.get("last_unique_by_tag", False)),
        )

    def event_name(self, params: Mapping[str, str] | None = None) -> str:
        """The event name with its first slot filled from the parameters."""
        return self.event.replace(EVENT_NAME_SLOT, (params or {}).get("event_name_param", ""), 1)

    def to_df(
        self, events: DataFrame, as_of: datetime, params: Mapping[str, str] | None = None
    ) -> DataFrame:
        """The source's events. The latest-per-tag flag overrides age and limit."""
        name = self.event_name(params)
        if not name:
            raise ValueError(f"source {self.id!r} resolves to an empty event name")
        if self.last_unique_by_tag:
            return retrieve.latest_by_tag(events, name, self.tags)
        rows = retrieve.with_tags(retrieve.named(events, name), self.tags)
        rows = retrieve.newer_than(rows, as_of, self.max_age_days)
        # Widgets order their own output, so only the limit needs an order here.
        return retrieve.newest(rows, self.max_results) if self.max_results > 0 else rows


@dataclass(frozen=True)
class SeriesSpec:
    """A widget's use of a source, with its own filters and mutators."""

    id: str
    tags: tuple[str, ...] = ()
    additional_info_filter: tuple[str, ...] = ()
    mutators: tuple[Mapping[str, Any], ...] = ()

    @classmethod
    def parse(cls, item: str | Mapping[str, Any]) -> SeriesSpec:
        if isinstance(item, str):
            return cls(item)
        if isinstance(item, Mapping) and item.get("id"):
            mutators = tuple(item.get("mutators") or ())
            check_mutators(mutators)
            return cls(
                id=item["id"],
                tags=tuple(retrieve.tag_list(item.get("tags"))),
                additional_info_filter=tuple(retrieve.tag_list(item.get("additional_info_filter"))),
                mutators=mutators,
            )
        raise ValueError(f"invalid data source {item!r}: expected an id or an object with an id")

    @property
    def label(self) -> str:
        return f"{self.id} [{', '.join(self.tags)}]" if self.tags else self.id


@dataclass(frozen=True)
class TimeAggregation:
    starting_value: str = "page_default"
    allow_selection: bool = True
    function: str = "sum"
    choices: tuple[str, ...] = ()

    @classmethod
    def parse(cls, config: Mapping[str, Any]) -> TimeAggregation:
        spec = cls(
            starting_value=config.get("starting_value") or "page_default",
            allow_selection=config.get("allow_selection", True),
            function=config.get("aggregation_function") or "sum",
            choices=tuple(config.get("choices") or ()),
        )
        for interval in (spec.starting_value, *spec.choices):
            if interval not in SELECTABLE:
                raise ValueError(f"unknown interval {interval!r}, expected one of {SELECTABLE}")
        if spec.function not in BUCKET_KINDS:
            raise ValueError(f"unknown bucket function {spec.function!r}, expected one of {BUCKET_KINDS}")
        return spec

    def interval(self, selection: str | None = None, page_default: str | None = None) -> str:
        """Widget choice, else the widget's start value, else the page's, else disabled."""
        chosen = self.starting_value
        if selection is not None:
            if not self.allow_selection:
                raise ValueError("this widget's interval cannot be selected")
            if selection not in (self.choices or SELECTABLE):
                raise ValueError(f"interval {selection!r} is not among {self.choices or SELECTABLE}")
            chosen = selection
        if chosen == "page_default":
            chosen = page_default or "disabled"
        return "disabled" if chosen == "page_default" else chosen


@dataclass(frozen=True)
class WidgetSpec:
    type: str
    title: str
    series: tuple[SeriesSpec, ...]
    time_aggregation: TimeAggregation | None = None
    time_range_filter: bool = False
    config: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def parse(cls, config: Mapping[str, Any]) -> WidgetSpec:
        kind = config.get("type")
        title = config.get("title", "")
        if kind not in WIDGETS:
            raise ValueError(f"unknown widget type {kind!r} for widget {title!r}")
        series = tuple(SeriesSpec.parse(item) for item in config.get("data_sources") or ())
        if kind in SINGLE_SOURCE and len(series) != 1:
            raise ValueError(f"{kind} widget {title!r} needs exactly one data source")
        aggregate = config.get("counter_type") if kind == "counter" else cls._aggregate(config)
        if kind in ("counter", "gauge", "pie_chart") and aggregate not in SCALAR_KINDS:
            raise ValueError(f"unknown aggregate {aggregate!r} for widget {title!r}")
        if kind in ("gauge", "pie_chart") and aggregate.endswith("datetime"):
            raise ValueError(f"{kind} widget {title!r} needs a number, not {aggregate!r}")
        time_aggregation = config.get("time_aggregation")
        return cls(
            type=kind,
            title=title,
            series=series,
            time_aggregation=TimeAggregation.parse(time_aggregation) if time_aggregation else None,
            time_range_filter=bool(config.get("time_range_filter", False)),
            config=config,
        )

    @staticmethod
    def _aggregate(config: Mapping[str, Any]) -> str:
        if config.get("type") == "pie_chart":
            return (config.get("style") or {}).get("aggregation_type") or "sum"
        return config.get("aggregation_type") or "last"

    @property
    def aggregate(self) -> str:
        return self.config["counter_type"] if self.type == "counter" else self._aggregate(self.config)

    @property
    def style(self) -> Mapping[str, Any]:
        style = self.config.get("style") or {}
        return style if isinstance(style, Mapping) else {}


@dataclass(frozen=True)
class ViewSpec:
    id: str
    sources: tuple[SourceSpec, ...]
    widgets: tuple[WidgetSpec, ...]
    default_time_aggregation: str = "disabled"
    default_event_name_param: str = ""
    event_name_param_choices: tuple[str, ...] = ()

    @classmethod
    def parse(cls, config: Mapping[str, Any]) -> ViewSpec:
        if not config.get("id"):
            raise ValueError("view without 'id'")
        choices: Sequence[Any] = config.get("event_name_param_choices") or ()
        return cls(
            id=config["id"],
            sources=tuple(SourceSpec.parse(s) for s in config.get("data") or ()),
            widgets=tuple(WidgetSpec.parse(w) for w in config.get("widgets") or ()),
            default_time_aggregation=config.get("default_time_aggregation") or "disabled",
            default_event_name_param=config.get("default_event_name_param") or "",
            event_name_param_choices=tuple(c["value"] if isinstance(c, Mapping) else c for c in choices),
        )

    def params(self, given: Mapping[str, str] | None = None) -> dict[str, str]:
        """Caller parameters completed with the view's default event name."""
        params = dict(given or {})
        params.setdefault("event_name_param", self.default_event_name_param)
        return params
