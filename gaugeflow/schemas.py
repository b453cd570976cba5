"""Record layouts. All are declared; nothing is inferred."""

from pyspark.sql import types as T

RAW_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("deviceId", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

# What the sliding aggregation reads: parsing fewer fields is cheaper.
WINDOW_EVENT = T.StructType([f for f in RAW_EVENT if f.name in ("id", "eventType", "value", "timestamp")])

TOPIC = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

STORED_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

#: Stored events are laid out by the UTC date of their time; one without a valid time has none.
EVENT_DATE = "event_date"

CLIENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("api_key", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

WINDOW_STATS = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("avg_value", T.DoubleType()),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("max_value", T.DoubleType()),
        T.StructField("event_count", T.LongType()),
    ]
)

DLQ = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

REQUEST_LOG = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("received_at_ms", T.LongType()),
        T.StructField("api_key", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("handler_status", T.IntegerType()),
    ]
)

ISSUES = T.ArrayType(
    T.StructType([T.StructField("field", T.StringType()), T.StructField("message", T.StringType())])
)

DISPOSITION = T.StructType(
    [
        *REQUEST_LOG.fields,
        T.StructField("client_id", T.StringType()),
        T.StructField("client_name", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("source_request_id", T.LongType()),
        T.StructField("errors", ISSUES),
    ]
)
