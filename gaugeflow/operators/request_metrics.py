"""Request metrics over a log: counts, duration histogram, requests in flight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.constants import DURATION_BOUNDS_SECONDS
from gaugeflow.operators.rules import is_measured_route

LABELS = ("method", "route", "status_code")


def measured(log: DataFrame) -> DataFrame:
    return log.where(is_measured_route(F.col("route")))


def request_counts(log: DataFrame) -> DataFrame:
    """Finished requests per method, route and status code."""
    return (
        measured(log)
        .where(F.col("duration_ms").isNotNull())
        .groupBy(*LABELS)
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def histogram(
    df: DataFrame, duration_ms_col: str, labels: Sequence[str], bounds: Sequence[float]
) -> DataFrame:
    """Cumulative bucket rows ``(labels..., le, bucket_count, duration_sum, duration_count)``.

    One conditional count per bound: the rows are aggregated before buckets become rows.
    """
    duration = F.col(duration_ms_col)
    texts = [f"{bound:g}" for bound in bounds]
    counted = (
        df.where(duration.isNotNull())
        .groupBy(*labels)
        .agg(
            *[F.count_if(duration <= round(bound * 1000)).alias(f"le_{i}") for i, bound in enumerate(bounds)],
            F.count(F.lit(1)).alias("duration_count"),
            F.sum(duration).alias("total_ms"),
        )
    )
    buckets = F.array(
        *[F.struct(F.lit(t).alias("le"), F.col(f"le_{i}").alias("n")) for i, t in enumerate(texts)],
        F.struct(F.lit("+Inf").alias("le"), F.col("duration_count").alias("n")),
    )
    return counted.withColumn("bucket", F.explode(buckets)).select(
        *labels,
        F.col("bucket.le").alias("le"),
        F.col("bucket.n").alias("bucket_count"),
        (F.col("total_ms") / 1000).alias("duration_sum"),
        "duration_count",
    )


def duration_histogram(log: DataFrame, bounds: Sequence[float] = DURATION_BOUNDS_SECONDS) -> DataFrame:
    """Request duration histogram per method, route and status code."""
    return histogram(measured(log), "duration_ms", LABELS, bounds)


def batch_duration_histogram(
    batches: DataFrame, bounds: Sequence[float] = DURATION_BOUNDS_SECONDS
) -> DataFrame:
    """The same histogram over batch write times, without labels."""
    return histogram(batches, "duration_ms", (), bounds)


#: The sweep's buckets, and what its bucket totals are summed over in turn.
SWEEP_BUCKET_MS, SWEEP_SPAN_MS = 60_000, 86_400_000


def _changes(log: DataFrame) -> DataFrame:
    """(at_ms, change): requests started less requests finished, per millisecond; summed map side."""
    start, end = F.col("received_at_ms"), F.col("received_at_ms") + F.col("duration_ms")
    steps = F.array(
        F.struct(start.alias("at_ms"), F.lit(1).cast("long").alias("change")),
        F.struct(end.alias("at_ms"), F.lit(-1).cast("long").alias("change")),
    )
    return (
        measured(log)
        .select(F.explode(steps).alias("c"))
        .select("c.*")
        .where("at_ms is not null")
        .groupBy("at_ms")
        .agg(F.sum("change").alias("change"))
    )


def _blocks(changes: DataFrame, bucket_ms: int) -> tuple[DataFrame, DataFrame]:
    """Running sums inside time buckets, and each bucket's offset: the requests in flight when it begins.

    A bucket has at most as many instants as milliseconds. Its sum and largest prefix are all that later steps need of it;
    offsets are summed over the buckets of a span and then over the spans, so no window holds more than a span's
    buckets or one row per span.
    """
    inside = Window.partitionBy("bucket").orderBy("at_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = changes.withColumn("bucket", F.floor(F.col("at_ms") / bucket_ms)).withColumn("inside", F.sum("change").over(inside))
    totals = running.groupBy("bucket").agg(
        F.sum("change").alias("total"),
        F.max(F.struct(F.col("inside").alias("prefix"), (-F.col("at_ms")).alias("later"))).alias("top"),
    )
    totals = totals.withColumn("span", F.floor(F.col("bucket") * bucket_ms / SWEEP_SPAN_MS))
    before = lambda window: F.coalesce(F.sum("total").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = totals.groupBy("span").agg(F.sum("total").alias("total"))
    spans = spans.select("span", before(Window.orderBy("span")).alias("span_offset"))
    placed = totals.withColumn("in_span", before(Window.partitionBy("span").orderBy("bucket"))).join(spans, "span")
    return running, placed.select("bucket", (F.col("span_offset") + F.col("in_span")).alias("offset"), "top")


def active_requests(log: DataFrame, bucket_ms: int = SWEEP_BUCKET_MS) -> DataFrame:
    """Requests in flight after each instant at which one started or finished, by a sweep in two phases.

    A request without a duration never finishes; one without a start is not counted.
    """
    running, blocks = _blocks(_changes(log), bucket_ms)
    joined = running.join(blocks.select("bucket", "offset"), "bucket")
    return joined.select("at_ms", (F.col("offset") + F.col("inside")).cast("long").alias("active_requests"))


def peak_requests(log: DataFrame, bucket_ms: int = SWEEP_BUCKET_MS) -> DataFrame:
    """(at_ms, active_requests): the first instant with the most requests in flight; from the buckets' largest prefixes alone."""
    _, blocks = _blocks(_changes(log), bucket_ms)
    peak = F.max(F.struct((F.col("offset") + F.col("top.prefix")).alias("active"), F.col("top.later").alias("later")))
    found = blocks.agg(peak.alias("peak")).where("peak is not null")
    return found.select((-F.col("peak.later")).alias("at_ms"), F.col("peak.active").cast("long").alias("active_requests"))
