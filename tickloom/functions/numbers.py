"""Number handling that follows the rules of the view configs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the longest leading text that reads as a decimal number.
LEADING_NUMBER = r"^\s*([+-]?(?:Infinity|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))"


def round_half_up(x: Column) -> Column:
    """Nearest integer with halves going toward +infinity (-2.5 -> -2)."""
    down = F.floor(x).cast("double")
    nearest = F.when(x - down >= 0.5, down + 1.0).otherwise(down)
    return F.when(F.abs(x) < float(2**53), nearest).otherwise(x)


def steady_round(x: Column, digits: int) -> Column:
    """Round a mean so that the order its values were added in does not show.

    A sum of doubles is off in its last bits, which would push a mean lying
    half-way between two results to either side; the first rounding clears them.
    """
    return F.round(F.round(x, digits + 5), digits)


def leading_number(text: Column) -> Column:
    """The number a text starts with, else NULL (`12ms` -> 12.0)."""
    return F.regexp_extract(text, LEADING_NUMBER, 1).try_cast("double")


def number_text(x: Column) -> Column:
    """A double as plain text: no trailing `.0`, no exponent for usual sizes."""
    plain = x.cast("string")
    whole = (F.abs(x) < 1e18) & (x == F.floor(x).cast("double"))
    wide = F.when(F.abs(x) < 1.0, x.try_cast("decimal(38,30)").cast("string")).otherwise(
        x.try_cast("decimal(38,22)").cast("string")
    )
    unpadded = F.rtrim(wide, F.lit("0"))
    return (
        F.when(whole, x.try_cast("bigint").cast("string"))
        .when(~F.contains(plain, F.lit("E")), plain)
        .otherwise(F.coalesce(unpadded, plain))
    )


def literal_text(x: object) -> str:
    """A config value as text, with whole numbers written without `.0`."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e18:
        return str(int(x))
    return str(x)


def literal_number(x: object) -> float | None:
    """A config value as a number; blank text counts as 0, other text as none."""
    if isinstance(x, str):
        x = x.strip() or 0
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
