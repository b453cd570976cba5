"""Rules a topic message must meet to be stored, and the split into stored and dead-lettered rows.

Looser than the gateway: no minimum type length, no drift test, any 64-bit timestamp, and text numerals are
taken as numbers because parameters reach a typed column as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.jsontypes import JsonField, computed_once, json_documents, read_field, with_fields
from gaugeflow.functions.text import canonical_uuid, is_storable_uuid

MESSAGE_FIELDS = ("id", "deviceId", "eventType", "value", "timestamp")
MAX_TYPE_LENGTH = 50

_NUMERAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
_SPECIAL = r"(?i)^\s*([+-]?(inf|infinity)|nan)\s*\z"
_INTEGER = r"^\s*[+-]?\d+\s*\z"


def _double(field: JsonField) -> Column:
    """A number, or a text numeral that a double can hold."""
    text = F.when(field.kind == "string", F.lower(F.trim(field.text)))
    numeral = F.when(text.rlike(_NUMERAL), text.try_cast("double"))
    return (
        F.when(field.kind == "number", field.number)
        .when(text.rlike(_SPECIAL), text.try_cast("double"))
        .when(F.abs(numeral) < F.lit(float("inf")), numeral)
    )


def _bigint(field: JsonField) -> Column:
    whole = field.is_whole_number() & (F.abs(field.number) < 2.0**63)
    return F.when(whole, field.number.cast("long")).when(
        (field.kind == "string") & field.text.rlike(_INTEGER), F.trim(field.text).try_cast("bigint")
    )


def with_stored_columns(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``reason`` (null for a storable message) and ``event``, its typed columns."""
    text = F.col(value_col).cast("string")
    raw_id, device, event_type, value, stamp = (read_field(F.col("__fields"), name) for name in MESSAGE_FIELDS)
    event = F.struct(
        F.when(is_storable_uuid(raw_id.text), canonical_uuid(raw_id.text)).alias("id"),
        F.when(is_storable_uuid(device.text), canonical_uuid(device.text)).alias("device_id"),
        event_type.text.alias("event_type"),
        _double(value).alias("value"),
        _bigint(stamp).alias("timestamp"),
    )
    column = lambda name: F.col("event")[name]
    reason = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty message")
        .when(F.coalesce(F.size("__docs") != 1, F.lit(True)), "not a JSON object")
        .when(F.col("__doc").isNull(), "not a JSON object")
        .when(column("id").isNull(), "id is not a UUID")
        .when(column("device_id").isNull(), "device_id is not a UUID")
        .when(column("event_type").isNull(), "event_type is null")
        .when(F.char_length(column("event_type")) > MAX_TYPE_LENGTH, "event_type is too long")
        .when(column("value").isNull(), "value is not a double")
        .when(column("timestamp").isNull(), "timestamp is not a bigint")
    )
    parsed = computed_once(messages, "__docs", json_documents(text, MESSAGE_FIELDS)).withColumn(
        "__doc", F.try_element_at("__docs", F.lit(1))
    )
    typed = computed_once(with_fields(parsed, "__doc", MESSAGE_FIELDS, "__fields"), "event", event)
    return typed.withColumn("reason", reason).drop("__docs", "__doc", "__fields")


def split_dlq(messages: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad): storable messages with their ``event`` struct, and ``(key, value, reason)`` of the rest."""
    checked = with_stored_columns(messages, value_col)
    good = checked.where(F.col("reason").isNull()).drop("reason")
    bad = checked.where(F.col("reason").isNotNull()).select("key", F.col(value_col).alias("value"), "reason")
    return good, bad


def stored_events(good: DataFrame, *extra: str) -> DataFrame:
    """Storage layout of the good rows; metadata does not reach the table."""
    return good.select("event.*", *extra)
