"""What the live page shows: log lines, cards, running means and the trailing chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.constants import CARD_TYPES, CHART_POINTS
from gaugeflow.functions.eventtime import event_time, floor_to
from gaugeflow.functions.text import to_fixed
from gaugeflow.operators.ordered import MAX_GROUP_ROWS, running_totals


def live_log_lines(events: DataFrame) -> DataFrame:
    """One feed line per event as the page (1 decimal) and the command line (2 decimals) print it."""
    device, kind = F.substring("deviceId", 1, 8), F.col("eventType")
    return events.select(
        "id",
        F.concat(
            device, F.lit(" > Type: "), kind, F.lit(" | Value: "), to_fixed(F.col("value"), 1)
        ).alias("page_line"),
        F.concat(
            F.lit("Device: "), device, F.lit("... | Type: "), kind,
            F.lit(" | Value: "), to_fixed(F.col("value"), 2),
        ).alias("cli_line"),
    )


def live_totals(events: DataFrame, types: Sequence[str] = CARD_TYPES) -> DataFrame:
    """Total events and the mean of the two card types to one decimal, one row; works on a stream too."""
    means = []
    for name, kind in zip(("temperature_avg", "cpu_avg"), types, strict=True):
        of_type = F.when(F.col("eventType") == kind, F.col("value"))
        mean = F.try_divide(F.sum(of_type).cast("double"), F.count(of_type))
        means.append(to_fixed(mean, 1).alias(name))
    return events.agg(F.count(F.lit(1)).alias("total_events"), *means)


DAY_MS = 86_400_000


def _shown(events: DataFrame, types: Sequence[str]) -> DataFrame:
    # Events without a time come before all days.
    day = F.coalesce(F.floor(F.col("timestamp") / DAY_MS), F.lit(-(2**40)))
    counts = F.when(F.col("value").isNotNull(), 1).otherwise(0).cast("long")
    shown = events.where(F.col("eventType").isin(*types))
    return shown.select("id", "eventType", "timestamp", "value", day.alias("day"), counts.alias("counts"))


def type_totals(events: DataFrame, types: Sequence[str] = CARD_TYPES, before: DataFrame | None = None) -> DataFrame:
    """(eventType, total, events): sum and number of the values of each card type, ``before`` included.

    Written, it is what the next run of ``running_type_avg`` takes as ``before``.
    """
    shown = _shown(events, types).select("eventType", F.col("value").alias("total"), F.col("counts").alias("events"))
    everything = shown if before is None else shown.unionByName(before)
    return everything.groupBy("eventType").agg(F.sum("total").cast(shown.schema["total"].dataType).alias("total"), F.sum("events").alias("events"))


def running_type_avg(
    events: DataFrame,
    types: Sequence[str] = CARD_TYPES,
    max_group_rows: int = MAX_GROUP_ROWS,
    before: DataFrame | None = None,
) -> DataFrame:
    """Mean value of the card types after each of their events, in (timestamp, id) order.

    There are few types, so each is cut into days: running totals inside a day, plus the totals of the days before it, one row
    per type and day. A day above ``max_group_rows`` is cut further. ``before`` are the totals of earlier events,
    as ``type_totals`` gives them; with them a run needs to read the new days only.
    """
    shown = _shown(events, types)
    running = running_totals(
        shown, ["eventType", "day"], ["timestamp", "id", "value"], {"total": F.col("value"), "events": F.col("counts")}, max_group_rows
    )
    earlier = Window.partitionBy("eventType").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        shown.groupBy("eventType", "day")
        .agg(F.sum("value").alias("day_total"), F.sum("counts").alias("day_events"))
        .select("eventType", "day", F.sum("day_total").over(earlier).alias("before_total"), F.sum("day_events").over(earlier).alias("before_events"))
    )
    joined = running.join(days, ["eventType", "day"])
    totals, counted = ["total", "before_total"], ["events", "before_events"]
    if before is not None:
        joined = joined.join(before.select("eventType", F.col("total").alias("run_total"), F.col("events").alias("run_events")), "eventType", "left")
        totals, counted = [*totals, "run_total"], [*counted, "run_events"]
    total, number = (sum((F.coalesce(c, F.lit(0)) for c in names), F.lit(0)) for names in (totals, counted))
    mean = F.try_divide(total.cast("double"), number)
    return joined.select("id", "eventType", "timestamp", mean.alias("running_avg"))


def trailing_chart(
    events: DataFrame, points: int = CHART_POINTS, first_type: str = CARD_TYPES[0]
) -> DataFrame:
    """The last ``points`` seconds with an event: both series, a missing value filled with the last one.

    Everything that is not ``first_type`` belongs to the second series; of several values in a second the latest counts. One scan
    reduces the events to seconds, map side; of these each task keeps the last ``points + 1`` of each series, before they
    meet. The extra one is the value a gap at the left edge is filled with.
    """
    series = F.when(F.col("eventType") == first_type, 1).otherwise(2).alias("series")
    seconds = (
        events.where(F.col("timestamp").isNotNull())
        .groupBy(floor_to(F.col("timestamp"), 1000).alias("second_ms"), series)
        .agg(F.max_by("value", F.struct("timestamp", "id")).alias("value"))
    )
    newest = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("second_ms")))
    tail = seconds.withColumn("rank", newest).where(F.col("rank") <= points + 1)
    of_series = {f"series_{n}": F.max(F.when(F.col("series") == n, F.col("value"))) for n in (1, 2)}
    latest = tail.groupBy("second_ms").agg(*[value.alias(name) for name, value in of_series.items()])
    # At most 2 * (points + 1) rows are left.
    so_far = Window.orderBy("second_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        latest.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in of_series})
        .orderBy(F.desc("second_ms"))
        .limit(points)
        .select(
            "second_ms",
            F.date_format(event_time(F.col("second_ms")), "HH:mm:ss").alias("label"),
            *of_series,
        )
    )
