"""Reads of the stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, n: int, time_col: str = "timestamp", id_col: str = "id") -> DataFrame:
    """The ``n`` latest events; each task keeps its own top ``n``, so nothing is sorted as a whole."""
    return events.orderBy(F.desc(time_col), id_col).limit(n)


def device_type_lookup(
    events: DataFrame,
    device_id: str,
    event_type: str,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    """Events of one device and type, optionally from ``from_ms`` up to but not including ``to_ms``.

    Plain comparisons: they reach the file scan, and files sorted by device and type (as ``store_events``
    writes them) are skipped by their statistics.
    """
    found = events.where((F.col("device_id") == device_id) & (F.col("event_type") == event_type))
    if from_ms is not None:
        found = found.where(F.col("timestamp") >= from_ms)
    if to_ms is not None:
        found = found.where(F.col("timestamp") < to_ms)
    return found
