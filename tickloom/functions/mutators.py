"""Value mutators, applied in list order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.numbers import round_half_up
from tickloom.operators.ordered import with_previous

# The operation names views use.
WITH_OPERAND = ("add", "subtract", "multiply", "divide")
ROW_WISE = (*WITH_OPERAND, "round", "floor", "ceil", "absolute", "remove_negatives")
SEQUENTIAL = ("to_delta", "to_percentage_change")


def check_mutators(mutators: Sequence[Mapping[str, Any]]) -> None:
    for m in mutators:
        op = m.get("operation")
        if op not in (*ROW_WISE, *SEQUENTIAL):
            raise ValueError(f"unknown mutator operation {op!r}")
        if op in WITH_OPERAND:
            try:
                float(m["value"])
            except (KeyError, TypeError, ValueError):
                raise ValueError(f"mutator {op!r} needs a number, got {m.get('value')!r}") from None


def mutate_value(x: Column, op: str, operand: float | None = None) -> Column:
    """One row-wise mutator as a column expression."""
    if op == "add":
        return x + F.lit(operand)
    if op == "subtract":
        return x - F.lit(operand)
    if op == "multiply":
        return x * F.lit(operand)
    if op == "divide":
        return x / F.lit(operand) if operand else x
    if op == "round":
        return round_half_up(x)
    if op == "floor":
        return F.when(F.abs(x) < float(2**53), F.floor(x).cast("double")).otherwise(x)
    if op == "ceil":
        return F.when(F.abs(x) < float(2**53), F.ceil(x).cast("double")).otherwise(x)
    if op == "absolute":
        return F.abs(x)
    if op == "remove_negatives":
        return F.when(x < 0, F.lit(0.0)).otherwise(x)
    raise ValueError(f"unknown mutator operation {op!r}")


def mutated(x: Column, mutators: Sequence[Mapping[str, Any]]) -> Column:
    """A chain of row-wise mutators as one column expression."""
    for m in mutators:
        x = mutate_value(x, m["operation"], float(m["value"]) if m["operation"] in WITH_OPERAND else None)
    return x


def change(x: Column, before: Column, op: str) -> Column:
    """Delta or percentage change against the preceding value.

    The first value of a series, and a change from 0, have no result.
    """
    if op == "to_delta":
        return x - before
    return F.when(before != 0, (x - before) / F.abs(before) * 100)


def apply_mutators(
    df: DataFrame,
    mutators: Sequence[Mapping[str, Any]],
    keys: Sequence[str] = (),
    tie: str | None = "event_id",
    bounded: bool = False,
) -> DataFrame:
    """Apply the mutators to `value`, series by series (`keys`).

    Row-wise mutators are one projection. All sequential ones share a single
    look at the preceding rows: n of them need the value and the n before it,
    and each turns neighbours into one result.
    """
    check_mutators(mutators)
    depth = sum(m["operation"] in SEQUENTIAL for m in mutators)
    names = ["value", *(f"_value{j}" for j in range(1, depth + 1))]
    shape = df.columns
    if depth:
        df = with_previous(df, ["value"], keys, tie=tie, bounded=bounded, depth=depth)
        df = df.withColumnsRenamed({f"prev{j if j > 1 else ''}_value": f"_value{j}" for j in range(1, depth + 1)})
    for m in mutators:
        op = m["operation"]
        if op in SEQUENTIAL:
            changed = {a: change(F.col(a), F.col(b), op) for a, b in zip(names, names[1:], strict=False)}
            names = names[:-1]
        else:
            operand = float(m["value"]) if op in WITH_OPERAND else None
            changed = {a: mutate_value(F.col(a), op, operand) for a in names}
        df = df.withColumns(changed)
    return df.select(*shape)
