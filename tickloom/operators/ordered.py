"""Order-dependent columns without one task per key.

A window over a key puts all of the key's rows into one task, which fails once
a single key holds a large share of the table. Here rows are sorted by range
into as many parts as their size asks for, so a large key spans several parts.
Windows run inside (part, key), and the few rows in front of a part are handed
to it as well. The sorted rows are written to the shared scratch folder: parts
must not change between the steps, and a lost executor costs no second sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import stored

ROW_BITS = 33  # monotonically_increasing_id: the part above, the row within it below


def _placed(df: DataFrame, order: Sequence[str | Column]) -> tuple[DataFrame, DataFrame]:
    """Rows in order with `_part`, `_row` (in the part, from 0), `_size` and
    `_start` (rows in all parts before); and the parts, one row each."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ordered.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumns(
        {"_part": F.shiftright("_place", ROW_BITS), "_row": F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)}
    ).drop("_place")
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per part of the sort, however large the frame is.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return rows.join(F.broadcast(parts), "_part"), parts


def with_previous(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    ts: str = "timestamp",
    tie: str | None = "event_id",
    bounded: bool = False,
    depth: int = 1,
) -> DataFrame:
    """Add `prev_<column>`: the column in the preceding row of the same key, and
    up to `depth` rows back as `prev2_<column>` and so on.

    `bounded=True` says the rows per key are few for another reason (they are
    time buckets); then one window per key is the cheaper plan.
    """
    order = [*keys, ts] if tie is None else [*keys, ts, tie]
    names = {(c, j): f"prev_{c}" if j == 1 else f"prev{j}_{c}" for c in columns for j in range(1, depth + 1)}
    if bounded:
        by_key = Window.partitionBy(*keys).orderBy(*order[len(keys) :])
        return df.select("*", *[F.lag(c, j).over(by_key).alias(name) for (c, j), name in names.items()])
    rows, parts = _placed(df, order)
    own = rows.withColumns({"_at": F.col("_start") + F.col("_row"), "_is_row": F.lit(1)})
    # The last rows of a part are handed to the parts that begin close behind them:
    # each part names the places it looks back at, and finds them by their number.
    ends = own.where(F.col("_size") - F.col("_row") <= depth).drop("_part", "_start", "_size")
    places = F.sequence(F.greatest(F.col("_start") - depth, F.lit(0)), F.col("_start") - 1)
    looked_at = parts.where(F.col("_start") > 0).select("_part", F.explode(places).alias("_at"))
    heads = ends.join(looked_at, "_at").withColumn("_is_row", F.lit(0))
    shape = [*df.columns, "_part", "_at", "_is_row"]
    inside = Window.partitionBy("_part", *keys).orderBy("_at")
    lags = [F.lag(c, j).over(inside).alias(name) for (c, j), name in names.items()]
    found = own.select(*shape).unionByName(heads.select(*shape)).select("*", *lags)
    return found.where(F.col("_is_row") == 1).select(*df.columns, *names.values())


def place_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add `_part`, and of the rows of a key in it `_rank` (from 1) and `_behind` (rows after the row)."""
    rows, _ = _placed(df, [*keys, *order])
    group = Window.partitionBy("_part", *keys)
    first, last = F.min("_row").over(group), F.max("_row").over(group)
    return rows.select(*df.columns, "_part", (F.col("_row") - first + 1).alias("_rank"), (last - F.col("_row")).alias("_behind"))


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """Add the 1-based position of every row in the given order."""
    rows, _ = _placed(df, order)
    return rows.select(*df.columns, (F.col("_start") + F.col("_row") + 1).alias(name))
