"""Gateway rules for a request: predicates and the collect-all validator.

Every predicate is a boolean column that is never null. The gateway is stricter than storage
(``storage_rules``) and aggregation (no rules at all); the three contracts are kept apart on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.constants import (
    CLOCK_DRIFT_MS,
    DEVICE_ID_MESSAGE,
    DRIFT_MESSAGE,
    MAX_BODY_BYTES,
    UNMEASURED_ROUTES,
)
from gaugeflow.functions.jsontypes import (
    JsonField,
    computed_once,
    json_documents,
    json_kind,
    read_field,
    with_fields,
)
from gaugeflow.functions.text import is_uuid, utf16_length
from gaugeflow.schemas import ISSUES

BODY_FIELDS = ("deviceId", "eventType", "value", "timestamp", "metadata")
TYPE_LENGTH = (2, 50)
# Whole numbers beyond this are not exact in a double and are refused.
MAX_SAFE_INTEGER = 2**53 - 1


def _never_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


# --- request level -----------------------------------------------------------------------------------------


def is_body_small_enough(body: Column, limit: int = MAX_BODY_BYTES) -> Column:
    return F.coalesce(F.octet_length(body) <= limit, F.lit(True))


def body_kind(body: Column, documents: Column) -> Column:
    """``absent``, ``empty``, ``object``, ``array`` or ``malformed``; the top level must be an object or array."""
    first = F.regexp_extract(body, r"^[ \t\r\n]*(.)", 1)
    bracketed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    one_array = bracketed.isNotNull() & F.try_variant_get(bracketed, "$[1]", "variant").isNull()
    return (
        F.when(body.isNull(), "absent")
        .when(body == "", "empty")
        .when((first == "{") & _never_null(F.size(documents) == 1), "object")
        .when((first == "[") & one_array, "array")
        .otherwise("malformed")
    )


def is_parseable(kind: Column) -> Column:
    return _never_null(kind != "malformed")


def is_present(header: Column) -> Column:
    """A header that is there and not empty."""
    return _never_null(header != "")


def is_known(client_id: Column) -> Column:
    return client_id.isNotNull()


def is_active(active: Column) -> Column:
    return _never_null(active)


def is_measured_route(route: Column) -> Column:
    return ~_never_null(route.isin(*UNMEASURED_ROUTES))


# --- body fields -------------------------------------------------------------------------------------------


def is_device_id(field: JsonField) -> Column:
    return _never_null((field.kind == "string") & is_uuid(field.text))


def is_event_type(field: JsonField) -> Column:
    return _never_null((field.kind == "string") & utf16_length(field.text).between(*TYPE_LENGTH))


def is_value(field: JsonField) -> Column:
    return field.is_finite_number()


def is_integer(field: JsonField) -> Column:
    return field.is_whole_number() & _never_null(F.abs(field.number) <= float(MAX_SAFE_INTEGER))


def is_timestamp(field: JsonField) -> Column:
    return is_integer(field) & _never_null(field.number > 0)


def is_within_drift(field: JsonField, now_ms: Column, drift_ms: int = CLOCK_DRIFT_MS) -> Column:
    return _never_null(field.number.between(now_ms - drift_ms, now_ms + drift_ms))


def bad_metadata_keys(value: Column) -> Column:
    """Keys of a metadata object whose value is no string, number or boolean; null for anything else."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))

    def is_bad(entry: Column) -> Column:
        field = JsonField.of(entry["value"])
        return ~_never_null(field.kind.isin("string", "boolean") | field.is_finite_number())

    return F.transform(F.filter(entries, is_bad), lambda entry: entry["key"])


def is_metadata(value: Column) -> Column:
    """An absent field, or an object of strings, numbers and booleans."""
    return value.isNull() | _never_null((json_kind(value) == "object") & (F.size(bad_metadata_keys(value)) == 0))


# --- collect every violation -------------------------------------------------------------------------------


def _issue(field: str, message: str | Column) -> Column:
    return F.struct(F.lit(field).alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _expected(kind: str, received: Column) -> Column:
    return F.concat(F.lit(f"Invalid input: expected {kind}, received "), received)


def _field_issues(values: Column, now_ms: Column) -> Column:
    device, event_type, value, stamp, metadata = (read_field(values, name) for name in BODY_FIELDS)
    low, high = TYPE_LENGTH
    is_text, length = event_type.kind == "string", utf16_length(event_type.text)
    value_is_number, stamp_is_number, whole = value.kind == "number", stamp.kind == "number", is_integer(stamp)
    none = F.expr("CAST(array() AS array<struct<field: string, message: string>>)")

    def when(condition: Column, field: str, message: str | Column) -> Column:
        return F.when(condition, F.array(_issue(field, message))).otherwise(none)

    return F.concat(
        when(device.kind != "string", "deviceId", _expected("string", device.kind)),
        when((device.kind == "string") & ~is_device_id(device), "deviceId", DEVICE_ID_MESSAGE),
        when(~is_text, "eventType", _expected("string", event_type.kind)),
        when(is_text & (length < low), "eventType", f"Too small: expected string to have >={low} characters"),
        when(is_text & (length > high), "eventType", f"Too big: expected string to have <={high} characters"),
        when(~value_is_number, "value", _expected("number", value.kind)),
        when(value_is_number & ~is_value(value), "value", "Invalid input: expected number, received Infinity"),
        when(~stamp_is_number, "timestamp", _expected("number", stamp.kind)),
        when(stamp_is_number & ~whole, "timestamp", "Invalid input: expected int, received number"),
        # The next two are both reported, but only for whole numbers.
        when(whole & (stamp.number <= 0), "timestamp", "Too small: expected number to be >0"),
        when(whole & ~is_within_drift(stamp, now_ms), "timestamp", DRIFT_MESSAGE),
        when(~metadata.kind.isin("undefined", "object"), "metadata", _expected("record", metadata.kind)),
    )


def _metadata_issues(value: Column) -> Column:
    def issue(key: Column) -> Column:
        return F.struct(F.concat(F.lit("metadata."), key).alias("field"), F.lit("Invalid input").alias("message"))

    return F.coalesce(F.transform(bad_metadata_keys(value), issue), F.array().cast(ISSUES))


def validate(df: DataFrame, now_col: str = "received_at_ms", body_col: str = "body") -> DataFrame:
    """Add ``body_kind`` and ``errors``, every violation of the body as ``{field, message}``.

    ``now_col`` is the receive time, so that a rerun gives the same verdict. A malformed body has null
    ``errors``: it is refused before validation.
    """
    body, kind = F.col(body_col), F.col("body_kind")
    root = _expected("object", F.when(kind == "array", "array").otherwise("undefined"))
    parsed = computed_once(df, "__docs", json_documents(body, BODY_FIELDS))
    seen = computed_once(parsed, "body_kind", body_kind(body, F.col("__docs"))).withColumn(
        "__doc", F.try_element_at("__docs", F.lit(1))
    )
    fields = with_fields(seen, "__doc", BODY_FIELDS, "__values")
    nested = computed_once(fields, "__nested", _metadata_issues(F.col("__doc")["metadata"]))
    issues = (
        F.when(kind == "malformed", F.lit(None))
        .when(kind.isin("absent", "array"), F.array(_issue("", root)))
        .otherwise(F.concat(_field_issues(F.col("__values"), F.col(now_col)), F.col("__nested")))
    )
    return computed_once(nested, "errors", issues).drop("__docs", "__doc", "__values", "__nested")


def validation_errors(df: DataFrame, id_col: str = "request_id") -> DataFrame:
    """One row per violation of a validated frame."""
    return df.select(id_col, F.explode("errors").alias("issue")).select(id_col, "issue.field", "issue.message")
