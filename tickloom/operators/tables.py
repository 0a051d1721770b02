"""Table widget: union, numbering, slicing, filters and row classes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.conditions import NUMERIC_FIELDS, evaluate
from tickloom.functions.numbers import literal_text, number_text
from tickloom.operators.ordered import number_rows
from tickloom.session import stored

# Event fields a table column may show.
EVENT_FIELDS = ("value", "tag", "time", "additional_info", "event_name", "index")
ROW_ORDER = ("source_pos", "tag_place", "timestamp", "event_id")


def time_text(ts: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss`, with microseconds only where there are any."""
    whole = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def field_column(event_field: str) -> Column:
    """The event column behind a table field."""
    if event_field not in EVENT_FIELDS:
        raise ValueError(f"unknown event_field {event_field!r}, expected one of {EVENT_FIELDS}")
    if event_field == "time":
        return time_text(F.col("timestamp"))
    if event_field == "additional_info":
        return F.coalesce("additional_info", F.lit(""))
    return F.col({"event_name": "name", "index": "row_index"}.get(event_field, event_field))


def field_text(event_field: str) -> Column:
    """A field as filter text."""
    column = field_column(event_field)
    if event_field == "value":
        return number_text(column)
    return column.cast("string")


def union_sources(frames: Sequence[DataFrame], by_tag: Sequence[bool] = ()) -> DataFrame:
    """All rows of the sources, in source order.

    Rows of a source are in time order; latest-per-tag sources (`by_tag`) come
    in tag order.
    """
    parts = []
    for pos, frame in enumerate(frames):
        tag_first = F.col("tag") if pos < len(by_tag) and by_tag[pos] else F.lit(None).cast("string")
        parts.append(frame.withColumn("source_pos", F.lit(pos)).withColumn("tag_place", tag_first))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def sliced(rows: DataFrame, max_rows: int | None, slice_from: str = "start") -> DataFrame:
    """The first or last `max_rows` rows with their position among all rows.

    Numbering happens on the slice: from the front it counts up, from the end
    it counts down from the total. Without a limit all rows are numbered, range
    by range. The order is that of the sources, in a latest-per-tag source by
    tag, then by time.
    """
    if not max_rows:
        return number_rows(rows, ROW_ORDER, "row_index")
    if slice_from not in ("start", "end"):
        raise ValueError(f"unknown slice_from {slice_from!r}")
    if slice_from == "start":
        kept = rows.orderBy(*ROW_ORDER).limit(max_rows)
        return kept.withColumn("row_index", F.row_number().over(Window.orderBy(*ROW_ORDER)).cast("long"))
    backward = [F.col(c).desc() for c in ROW_ORDER]
    total = rows.agg(F.count(F.lit(1))).scalar()
    kept = rows.orderBy(*backward).limit(max_rows)
    return kept.withColumn("row_index", total - F.row_number().over(Window.orderBy(*backward)) + 1)


def row_class(rules: Sequence[Mapping[str, Any]]) -> Column:
    """Class of a row; of all rules that hold, the last one listed wins."""
    chosen = F.lit("")
    for rule in rules:
        name = rule["event_field"]
        field = F.col("additional_info") if name == "additional_info" else field_column(name)
        holds = evaluate(field, rule.get("condition"), rule.get("value"), name in NUMERIC_FIELDS)
        chosen = F.when(holds, F.lit(f"table-{rule['color']}")).otherwise(chosen)
    return chosen


def fields_by_title(columns: Sequence[Mapping[str, str]]) -> dict[str, str]:
    return {c["title"]: c["event_field"] for c in columns}


def filter_choices(
    rows: DataFrame, event_field: str, choices: int | Sequence[Any] | None = None
) -> DataFrame:
    """Choices a filter offers, over all rows of the table.

    A list is taken as given; a number k gives the k most common values (equal
    counts in value order); otherwise every distinct non-empty value.
    """
    if choices and not isinstance(choices, int):
        texts = F.array(*[F.lit(literal_text(c)) for c in choices])
        return rows.sparkSession.range(1, numPartitions=1).select(F.explode(texts).alias("choice"))
    if event_field == "index":
        rows = number_rows(rows, ROW_ORDER, "row_index")
    values = rows.select(field_text(event_field).alias("choice")).where(F.col("choice") != "")
    if not choices:
        return values.distinct().orderBy("choice")
    counts = values.groupBy("choice").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "choice").limit(int(choices)).select("choice")


def heavy_choices(rows: DataFrame, event_field: str, choices: int, tracked: int = 1024, most: int = 1 << 18) -> DataFrame:
    """The `choices` most common values of a field with very many different ones, exactly.

    Every task keeps a sketch of `tracked` candidates; merged, it holds each value
    whose count is beyond a known share of the rows. A second pass counts the
    candidates exactly. If the last of the choices is beyond that share, no value
    outside can be among them; otherwise the sketch is made four times as large,
    and beyond `most` all values are counted. Only sketches and counts of
    candidates are shuffled, `tracked` rows a task at most.
    """
    values = rows.select(field_text(event_field).alias("choice")).where(F.col("choice") != "")
    while tracked <= most:
        sketch = F.expr(f"approx_top_k(choice, {tracked}, {tracked})")
        top, n = values.agg(sketch.alias("top"), F.count(F.lit(1)).alias("n")).first()
        found = [r["item"] for r in top or ()]
        candidates = rows.sparkSession.createDataFrame([(c,) for c in found], "choice string")
        counts = values.join(F.broadcast(candidates), "choice").groupBy("choice").agg(F.count(F.lit(1)).alias("n"))
        counts = stored(counts, "heavy-choices")
        ranked = counts.orderBy(F.col("n").desc(), "choice").limit(int(choices))
        last = ranked.agg(F.count(F.lit(1)), F.min("n")).first()
        if not n or (last[0] == choices and last[1] > _unseen(tracked, n)):
            return ranked.select("choice")
        tracked *= 4
    return filter_choices(rows, event_field, choices)


def _unseen(tracked: int, n: int) -> float:
    """How often a value can occur among n that the sketch does not name: 3.5 over
    the slots of its map, a power of two of which three quarters are used."""
    slots = 1 << math.ceil(math.log2(tracked / 0.75))
    return 3.5 / slots * n


def apply_filters(
    rows: DataFrame, columns: Sequence[Mapping[str, str]], selected: Mapping[str, Sequence[Any]]
) -> DataFrame:
    """Rows whose value is selected in every filter; an empty selection hides all."""
    fields = fields_by_title(columns)
    for title, values in selected.items():
        text = F.coalesce(field_text(fields[title]), F.lit("")) if title in fields else F.lit("")
        rows = rows.where(text.isin([literal_text(v) for v in values]) if values else F.lit(False))
    return rows


def table(
    rows: DataFrame,
    columns: Sequence[Mapping[str, str]],
    max_rows: int | None = None,
    slice_from: str = "start",
    color_rules: Sequence[Mapping[str, Any]] = (),
    selected: Mapping[str, Sequence[Any]] | None = None,
) -> DataFrame:
    """Sliced, filtered table with one column per title, plus position and class."""
    shown = sliced(rows, max_rows, slice_from)
    if selected:
        shown = apply_filters(shown, columns, selected)
    cells = [field_column(c["event_field"]).alias(c["title"]) for c in columns]
    return shown.select(*cells, row_class(color_rules).alias("row_class"), F.col("row_index").alias("row_position"))
