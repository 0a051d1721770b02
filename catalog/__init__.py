"""Every registered query next to the SQL that states its result."""

from __future__ import annotations

from catalog import aggregation, ingest, maintenance, reads, streams, timeseries, widgets  # noqa: F401
from catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
