"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.constants import RAW_TOPIC


def start_stream(
    df: DataFrame,
    path: str | None,
    checkpoint: str,
    fmt: str = "parquet",
    trigger: dict | None = None,
    mode: str = "append",
    **options: str,
) -> StreamingQuery:
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start(path) if path else writer.start()


def write_topic(df: DataFrame, path_or_topic: str = RAW_TOPIC, fmt: str = "kafka", **options: str) -> None:
    """Append ``(key, value)`` records to a topic, or to files where there is no broker."""
    writer = df.select("key", "value").write.format(fmt).options(**options)
    if fmt == "kafka":
        writer.option("topic", path_or_topic).save()
    else:
        writer.mode("append").save(path_or_topic)


def write_topic_stream(
    df: DataFrame, path_or_topic: str, checkpoint: str, fmt: str = "kafka", trigger: dict | None = None, **options: str
) -> StreamingQuery:
    records = df.select("key", "value")
    if fmt == "kafka":
        return start_stream(records, None, checkpoint, fmt, trigger, topic=path_or_topic, **options)
    return start_stream(records, path_or_topic, checkpoint, fmt, trigger, **options)


def write_dlq(bad: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Dead letters: key and value unchanged, plus the reason."""
    bad.select("key", "value", "reason").write.format(fmt).mode(mode).save(path)


def write_dispositions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("append").save(path)
