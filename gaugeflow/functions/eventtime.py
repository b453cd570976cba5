"""Epoch-millisecond arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MS = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def duration_ms(text: str) -> int:
    """Milliseconds of a fixed-length duration such as ``"5 minutes"``."""
    match = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", text.lower())
    if not match or match[2] not in _UNIT_MS:
        raise ValueError(f"not a fixed-length duration: {text!r}")
    return int(match[1]) * _UNIT_MS[match[2]]


#: Years 1 to 9999, what dates and timestamps of all engines hold.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def has_event_time(ms: Column) -> Column:
    """True where ``ms`` is a time at all; a nanosecond count or a 64-bit limit is not. Null for null."""
    return ms.between(FIRST_MS, LAST_MS)


def event_time(ms: Column) -> Column:
    """Exact timestamp of an epoch-millisecond column; null, not an error, outside the years 1 to 9999."""
    return F.timestamp_millis(F.when(has_event_time(ms), ms))


def floor_to(ms: Column, step_ms: int) -> Column:
    """Start of the epoch-aligned step that holds ``ms`` (also before 1970)."""
    return ms - F.pmod(ms, F.lit(step_ms).cast("long"))
