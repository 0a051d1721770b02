"""Row conditions of table colour rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom.functions.numbers import literal_number, literal_text, number_text

NUMERIC_FIELDS = ("value", "index")


def as_text(field: Column, numeric: bool) -> Column:
    """Field as comparison text; a missing field reads `null`."""
    return F.coalesce(number_text(field.cast("double")) if numeric else field.cast("string"), F.lit("null"))


def as_number(field: Column, numeric: bool) -> Column:
    """Field as a number: blank or missing text is 0, other text is NULL."""
    if numeric:
        return F.coalesce(field.cast("double"), F.lit(0.0))
    text = F.trim(F.coalesce(field.cast("string"), F.lit("")))
    return F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))


def evaluate(field: Column, condition: str, wanted: object, numeric: bool = False) -> Column:
    """Boolean column for one condition; an unknown condition never holds."""
    if condition in ("equals", "not_equals"):
        text = literal_text(wanted)
        if numeric:
            # Compare as numbers where the wanted text is how a number prints.
            number = literal_number(wanted)
            prints_so = number is not None and literal_text(number) == text
            same = F.coalesce(field.cast("double") == F.lit(number), F.lit(False)) if prints_so else F.lit(False)
        else:
            same = as_text(field, numeric) == F.lit(text)
        return same if condition == "equals" else ~same
    if condition in ("greater_than", "less_than"):
        number = literal_number(wanted)
        if number is None:
            return F.lit(False)
        left = as_number(field, numeric)
        holds = left > F.lit(number) if condition == "greater_than" else left < F.lit(number)
        return F.coalesce(holds, F.lit(False))
    if condition == "contains":
        return F.contains(as_text(field, numeric), F.lit(literal_text(wanted)))
    return F.lit(False)
