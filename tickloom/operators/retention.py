"""Retention: which events have expired, and under which rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.buckets import days_before
from tickloom.model import micros

# Rules beyond this many are looked up.
IN_ONE_EXPRESSION = 64


@dataclass(frozen=True)
class RetentionRule:
    """Events of a name (and tag, if given) expire after `max_age_days`."""

    event_name: str
    max_age_days: float
    tag: str | None = None

    @classmethod
    def parse(cls, rule: Mapping[str, Any]) -> RetentionRule:
        for required in ("event_name", "max_age_days"):
            if rule.get(required) is None:
                raise ValueError(f"invalid retention rule {dict(rule)}: missing {required!r}")
        return cls(rule["event_name"], rule["max_age_days"], rule.get("tag") or None)


def check_rules(rules: Sequence[RetentionRule]) -> None:
    """Reject the whole set before anything is written."""
    for rule in rules:
        if not rule.event_name or rule.max_age_days is None:
            raise ValueError(f"invalid retention rule {rule}")


def _first_hit(rules: Sequence[RetentionRule], as_of: datetime) -> Column:
    found = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        hit = (F.col("name") == r.event_name) & (F.unix_micros("timestamp") < micros(days_before(as_of, r.max_age_days)))
        if r.tag is not None:
            hit = hit & (F.col("tag") == r.tag)
        found = F.when(hit, F.lit(i)).otherwise(found)
    return found


def with_rule(df: DataFrame, rules: Sequence[RetentionRule], as_of: datetime, column: str = "_rule") -> DataFrame:
    """Add the index of the rule that deletes a row, NULL for rows that stay.

    Rules run one after the other, so a row counts for the first that hits it. A
    few are one expression; a long list goes out as one row per event name, which
    the events look up, so the plan does not grow with their number.
    """
    check_rules(rules)
    if len(rules) <= IN_ONE_EXPRESSION:
        return df.withColumn(column, _first_hit(rules, as_of))
    by_name: dict[str, list[tuple[int, str | None, int]]] = {}
    for i, r in enumerate(rules):
        by_name.setdefault(r.event_name, []).append((i, r.tag, micros(days_before(as_of, r.max_age_days))))
    listed = df.sparkSession.createDataFrame(list(by_name.items()), "_named string, _rules array<struct<idx int, tag string, cutoff long>>")
    late = F.unix_micros("timestamp")
    hits = F.filter("_rules", lambda r: (r["tag"].isNull() | F.coalesce(r["tag"] == F.col("tag"), F.lit(False))) & (late < r["cutoff"]))
    found = df.join(F.broadcast(listed), F.col("name") == F.col("_named"), "left")
    return found.select(*df.columns, F.try_element_at(hits, F.lit(1))["idx"].alias(column))


def retained(df: DataFrame, rules: Sequence[RetentionRule], as_of: datetime) -> DataFrame:
    return with_rule(df, rules, as_of).where(F.col("_rule").isNull()).drop("_rule")


def deleted_counts(df: DataFrame, rules: Sequence[RetentionRule], as_of: datetime) -> DataFrame:
    """Deleted events per rule, in one scan; rules that hit nothing count 0."""
    hits = (
        with_rule(df, rules, as_of, "rule_idx")
        .where(F.col("rule_idx").isNotNull())
        .groupBy("rule_idx")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    described = df.sparkSession.createDataFrame(
        [(i, r.event_name, r.tag, float(r.max_age_days)) for i, r in enumerate(rules)],
        "rule_idx int, event_name string, tag string, max_age_days double",
    )
    return described.join(hits, "rule_idx", "left").select(
        "rule_idx", "event_name", "tag", "max_age_days", F.coalesce("hits", F.lit(0)).alias("deleted")
    )
