"""Sliding-window statistics per event type."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.constants import WATERMARK, WINDOW_SIZE, WINDOW_SLIDE
from gaugeflow.functions.eventtime import duration_ms, event_time, floor_to, has_event_time
from gaugeflow.operators.parse import with_event_time

STATS = ("avg_value", "min_value", "max_value", "event_count")


def window_starts(pane: Column, size_ms: int, slide_ms: int) -> Column:
    """Starts of all windows that hold the pane, earliest first."""
    last = floor_to(pane, slide_ms)
    # Slides back from the last window while the window still ends after the pane.
    back = F.floor((last - pane + size_ms - 1) / slide_ms).cast("long") * slide_ms
    return F.sequence(last - back, last, F.lit(slide_ms).cast("long"))


def _batch(events: DataFrame, size: str, slide: str) -> DataFrame:
    size_ms, slide_ms = duration_ms(size), duration_ms(slide)
    pane_ms = math.gcd(size_ms, slide_ms)
    # Panes first: each event is aggregated once, map side, and only pane totals are copied into windows.
    panes = (
        events.where(has_event_time(F.col("timestamp")))
        .groupBy(floor_to(F.col("timestamp"), pane_ms).alias("pane"), "eventType")
        .agg(
            F.sum("value").alias("total"),
            F.count("value").alias("valued"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.count("id").alias("events"),
        )
    )
    return (
        panes.select(
            F.explode(window_starts(F.col("pane"), size_ms, slide_ms)).alias("start"),
            "eventType", "total", "valued", "low", "high", "events",
        )
        .groupBy("start", "eventType")
        .agg(
            F.sum("total").alias("total"),
            F.sum("valued").alias("valued"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.sum("events").alias("event_count"),
        )
        .select(
            event_time(F.col("start")).alias("window_start"),
            event_time(F.col("start") + size_ms).alias("window_end"),
            "eventType",
            F.try_divide(F.col("total").cast("double"), F.col("valued")).alias("avg_value"),
            F.col("low").cast("double").alias("min_value"),
            F.col("high").cast("double").alias("max_value"),
            "event_count",
        )
    )


def aggregate_windows(timed: DataFrame, size: str, slide: str) -> DataFrame:
    """Aggregates of a stream whose ``event_time`` carries the watermark."""
    return (
        timed.groupBy(F.window("event_time", size, slide), "eventType")
        .agg(
            F.try_divide(F.sum("value").cast("double"), F.count("value")).alias("avg_value"),
            F.min("value").cast("double").alias("min_value"),
            F.max("value").cast("double").alias("max_value"),
            F.count("id").alias("event_count"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "eventType",
            *STATS,
        )
    )


def window_stats(
    events: DataFrame,
    size: str = WINDOW_SIZE,
    slide: str = WINDOW_SLIDE,
    watermark: str = WATERMARK,
    ahead: str = "1 day",
) -> DataFrame:
    """avg/min/max of ``value`` and count of ``id`` per sliding window and ``eventType``.

    Events need ``id, eventType, value, timestamp`` (epoch ms). Redelivered events count again. A stream drops
    an event only from windows that end at or before the watermark; a batch has no late events.
    A decimal ``value`` is summed exactly. An event without a time, or with one outside the years 1 to 9999, is
    in no window. A stream also leaves out events more than ``ahead`` of the clock: one of them would move the watermark
    past all honest events.
    """
    if duration_ms(slide) > duration_ms(size):
        raise ValueError("the slide must not be longer than the window")
    if events.isStreaming:
        latest = F.unix_millis(F.current_timestamp()) + duration_ms(ahead)
        events = events.where(F.col("timestamp") <= latest)
        return aggregate_windows(with_event_time(events).withWatermark("event_time", watermark), size, slide)
    return _batch(events, size, slide)


def pane_window_stats(
    events: DataFrame,
    size: str = WINDOW_SIZE,
    slide: str = WINDOW_SLIDE,
    watermark: str = WATERMARK,
    ahead: str = "1 day",
) -> DataFrame:
    """As ``window_stats`` of a stream, by two chained aggregations: of events into panes, then of finished panes into windows.

    An event is in one pane of state, not in all windows that hold it: the panes are as long as the common divisor of size
    and slide. A pane is passed on when the watermark has passed its end, and a window is emitted in append mode when it has passed
    the window's. So lateness is decided by the pane: an event is dropped from all of its windows once its pane has ended
    before the watermark, while ``window_stats`` still takes it into those of its windows that are open. Without
    late events both give the same.
    """
    if duration_ms(slide) > duration_ms(size):
        raise ValueError("the slide must not be longer than the window")
    latest = F.unix_millis(F.current_timestamp()) + duration_ms(ahead)
    timed = with_event_time(events.where(F.col("timestamp") <= latest)).withWatermark("event_time", watermark)
    pane = f"{math.gcd(duration_ms(size), duration_ms(slide))} milliseconds"
    panes = (
        timed.groupBy(F.window("event_time", pane).alias("pane"), "eventType")
        .agg(
            F.sum("value").alias("total"),
            F.count("value").alias("valued"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.count("id").alias("events"),
        )
        .select(F.window_time("pane").alias("pane_time"), "eventType", "total", "valued", "low", "high", "events")
    )
    return (
        panes.groupBy(F.window("pane_time", size, slide), "eventType")
        .agg(
            F.try_divide(F.sum("total").cast("double"), F.sum("valued")).alias("avg_value"),
            F.min("low").cast("double").alias("min_value"),
            F.max("high").cast("double").alias("max_value"),
            F.sum("events").alias("event_count"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "eventType", *STATS)
    )


def type_stats(events: DataFrame) -> DataFrame:
    """The same four aggregates per ``eventType`` over all events; a null type is its own group."""
    return events.groupBy("eventType").agg(
        F.try_divide(F.sum("value").cast("double"), F.count("value")).alias("avg_value"),
        F.min("value").cast("double").alias("min_value"),
        F.max("value").cast("double").alias("max_value"),
        F.count("id").alias("event_count"),
    )
