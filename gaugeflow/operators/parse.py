"""Raw messages to typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.eventtime import event_time
from gaugeflow.schemas import RAW_EVENT


def decode_value(df: DataFrame, value_col: str = "value") -> DataFrame:
    """The message value, text or bytes, as one string column ``json_value``."""
    return df.select(F.col(value_col).cast("string").alias("json_value"))


def delivered_events(messages: DataFrame, schema: T.StructType = RAW_EVENT) -> DataFrame:
    """Typed event columns of each topic message, with its ``partition`` and ``offset``."""
    parsed = messages.select(F.from_json(F.col("value").cast("string"), schema).alias("data"), "partition", "offset")
    return parsed.select("data.*", "partition", "offset")


def parse_events(df: DataFrame, schema: T.StructType = RAW_EVENT, value_col: str = "value") -> DataFrame:
    """Typed event columns of each message.

    Permissive: a malformed message becomes a row of nulls and a wrong-typed field becomes null while its
    siblings stay. Pass a narrower ``schema`` to parse only what the query reads.
    """
    return decode_value(df, value_col).select(F.from_json("json_value", schema).alias("data")).select("data.*")


def with_event_time(events: DataFrame, ms_col: str = "timestamp", name: str = "event_time") -> DataFrame:
    return events.withColumn(name, event_time(F.col(ms_col)))
