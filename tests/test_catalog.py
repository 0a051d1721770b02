"""Every query against the SQL that states its result."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry_points
from catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = compare.connect(sf_dir)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    got = compare.spark_table(QUERIES[name](spark, sf_dir))
    assert compare.difference(got, compare.sql_table(con, SQL[name])) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


def test_entry_has_rows(spark):
    first = entry_points.entry(spark)
    assert first.columns == ["series_idx", "name", "timestamp", "value", "n"]
    assert first.count() > 0


def test_results_do_not_depend_on_partitioning(spark, sf_001):
    """Means and orders stay the same however rows are spread over tasks."""
    from catalog.aggregation import _scalars
    from catalog.base import order
    from tickloom.functions.aggregates import SCALAR_KINDS

    kinds = [k for k in SCALAR_KINDS if not k.endswith("datetime")]
    frame = order(spark, sf_001)
    one = compare.spark_table(_scalars(frame.coalesce(1), ["tag"], kinds))
    many = compare.spark_table(_scalars(frame.repartition(37, "event_id"), ["tag"], kinds))
    assert one == many
