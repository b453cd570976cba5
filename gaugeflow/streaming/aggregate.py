"""Streaming aggregation: finalized windows to a table, running cards to a live sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.constants import CARD_TYPES, WATERMARK, WINDOW_SIZE, WINDOW_SLIDE
from gaugeflow.operators.live import live_totals
from gaugeflow.operators.parse import parse_events
from gaugeflow.operators.window_stats import aggregate_windows, window_stats
from gaugeflow.schemas import WINDOW_EVENT
from gaugeflow.sources.writers import start_stream
from gaugeflow.streaming.dedup import dedup_stream


def stream_window_stats(
    raw: DataFrame,
    size: str = WINDOW_SIZE,
    slide: str = WINDOW_SLIDE,
    watermark: str = WATERMARK,
    dedup: bool = False,
) -> DataFrame:
    """Raw topic stream to window statistics; only the fields the aggregation reads are parsed.

    Redelivered messages count again unless ``dedup`` is set, which drops repeated ids within the watermark.
    """
    events = parse_events(raw, WINDOW_EVENT)
    if not dedup:
        return window_stats(events, size, slide, watermark)
    return aggregate_windows(dedup_stream(events, "id", watermark), size, slide)


def write_window_stats(
    df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger: dict | None = None
) -> StreamingQuery:
    """Append each window once, after the watermark has passed its end.

    The file sink and the checkpoint make the output exactly-once over restarts. ``fmt="delta"`` where the
    format is installed.
    """
    return start_stream(df, path, checkpoint, fmt, trigger)


def start_live_totals(
    events: DataFrame, name: str, types: tuple[str, str] = CARD_TYPES, fmt: str = "memory", trigger: dict | None = None
) -> StreamingQuery:
    """The cards over everything seen so far, rewritten with every batch; the state is one row."""
    writer = live_totals(events, types).writeStream.format(fmt).outputMode("complete").queryName(name)
    return (writer.trigger(**trigger) if trigger else writer).start()


def live_feed(payload: DataFrame) -> DataFrame:
    """Every published event as JSON text, for a second sink next to the topic."""
    return payload.select(F.to_json(F.struct(*payload.columns)).alias("value"))
