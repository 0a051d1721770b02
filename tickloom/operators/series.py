"""Series: which events feed which line, slice or table of a widget."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.mutators import SEQUENTIAL, apply_mutators, mutated
from tickloom.plans.specs import SeriesSpec


def belongs(spec: SeriesSpec) -> Column | None:
    """Membership test of a series; None when it takes every row."""
    tests = []
    if spec.tags:
        tests.append(F.col("tag").isin(list(spec.tags)))
    if spec.additional_info_filter:
        tests.append(F.col("additional_info").isin(list(spec.additional_info_filter)))
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def fan_out(df: DataFrame, series: Sequence[tuple[int, SeriesSpec]]) -> DataFrame:
    """Give every row the `series_idx` of each series it belongs to.

    One pass over the source however many series it feeds, with no join: the
    memberships are expressions, and their union also filters the scan.
    """
    tests = [(idx, belongs(spec)) for idx, spec in series]
    if len(tests) == 1:
        idx, test = tests[0]
        rows = df if test is None else df.where(test)
        return rows.withColumn("series_idx", F.lit(idx))
    if all(test is not None for _, test in tests):
        any_of = tests[0][1]
        for _, test in tests[1:]:
            any_of = any_of | test
        df = df.where(any_of)
    marks = [F.lit(idx) if test is None else F.when(test, F.lit(idx)) for idx, test in tests]
    spread = df.select("*", F.explode(F.array(*marks)).alias("series_idx"))
    return spread.where(F.col("series_idx").isNotNull())


def series_frame(sources: Mapping[str, DataFrame], series: Sequence[SeriesSpec]) -> DataFrame:
    """Events of all series of a widget, tagged with `series_idx`."""
    by_source: dict[str, list[tuple[int, SeriesSpec]]] = {}
    for idx, spec in enumerate(series):
        by_source.setdefault(spec.id, []).append((idx, spec))
    parts = [fan_out(sources[sid], members) for sid, members in by_source.items()]
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part)
    return frame


def mutate_series(
    df: DataFrame,
    series: Sequence[SeriesSpec],
    tie: str | None = "event_id",
    bounded: bool = False,
) -> DataFrame:
    """Apply each series' own mutators.

    Row-wise chains of all series are one projection over one pass; only series
    with sequential steps are read again, once for each distinct chain.
    """
    chains: dict[str, list[int]] = {}
    for idx, spec in enumerate(series):
        chains.setdefault(repr(spec.mutators), []).append(idx)
    if len(chains) == 1:
        return apply_mutators(df, series[0].mutators, ["series_idx"], tie, bounded)
    row_wise, sequential = F.col("value"), []
    for members in chains.values():
        mutators = series[members[0]].mutators
        own = F.col("series_idx").isin(members)
        if any(m["operation"] in SEQUENTIAL for m in mutators):
            sequential.append((own, mutators))
        elif mutators:
            row_wise = F.when(own, mutated(F.col("value"), mutators)).otherwise(row_wise)
    rest = df
    for own, _ in sequential:
        rest = rest.where(~own)
    parts = [rest.withColumn("value", row_wise)] if len(sequential) < len(chains) else []
    parts += [apply_mutators(df.where(own), mutators, ["series_idx"], tie, bounded) for own, mutators in sequential]
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part)
    return frame
