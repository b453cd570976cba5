"""Telemetry inputs derived from the ``events`` test table.

Plain modulo arithmetic on the event id, so that the same rows can be written in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.session import configure

RETRIES = {"in flight": 1_000_000_000, "after finish": 2_000_000_000, "at expiry": 3_000_000_000}
CARD_STAND_INS = ("click", "view")


def _e() -> Column:
    return F.col("event_id")


def _uuid(block: str, number: Column) -> Column:
    return F.concat(F.lit(f"00000000-0000-4000-{block}-"), F.lpad(number.cast("string"), 12, "0"))


def source_events(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    configure(spark)
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    if not streaming:
        return table
    return spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before JSON work: a small test table is one file that one task would read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.isStreaming or df.rdd.getNumPartitions() < cores else df


def _milliseconds() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def raw_events(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """RAW_EVENT rows. The values have two decimals and are kept as decimals: their sums are exact."""
    return source_events(spark, sf_dir, streaming).select(
        _uuid("8000", _e()).alias("id"),
        _uuid("8001", F.col("user_id")).alias("deviceId"),
        F.col("event_type").alias("eventType"),
        F.col("value").cast("decimal(18,2)").alias("value"),
        _milliseconds().alias("timestamp"),
        F.from_json("props", "map<string,string>").alias("metadata"),
    )


_MS = "unix_millis(CAST(ts AS TIMESTAMP))"
_DEVICE = "concat('00000000-0000-4000-8001-', lpad(CAST(user_id AS STRING), 12, '0'))"
_ID = "concat('00000000-0000-4000-8000-', lpad(CAST(event_id AS STRING), 12, '0'))"


def _json(first: str, kind: str, value: str) -> str:
    """JSON text of an event; some values are text and some device ids are not UUIDs."""
    return f"""to_json(struct({first}
        CASE WHEN event_id % 43 = 0 THEN concat(substring({_DEVICE}, 1, 33), 'xyz') ELSE {_DEVICE} END AS deviceId,
        {kind} AS eventType,
        CASE WHEN event_id % 41 = 0 THEN to_variant_object(array(CAST({value} AS STRING)))
             ELSE to_variant_object(array({value})) END:[0] AS value,
        {_MS} AS timestamp,
        try_parse_json(props) AS metadata))"""


def topic_messages(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """TOPIC rows: one message per event, some bad, and later redeliveries with another value."""
    sent = spread(source_events(spark, sf_dir, streaming)).selectExpr(
        "*", "explode(IF(event_id % 11 = 0, array(0, 1), array(0))) AS copy"
    )
    message = _json(
        f"{_ID} AS id,", "CASE WHEN event_id % 37 = 0 THEN repeat('x', 51) ELSE event_type END", "value + copy"
    )
    return sent.selectExpr(
        f"{_DEVICE} AS key",
        f"CASE WHEN event_id % 47 = 0 THEN 'not json' ELSE {message} END AS value",
        "'metrics.raw' AS topic",
        "CAST(user_id % 8 AS INT) AS partition",
        f"event_id + copy * {RETRIES['in flight']} AS offset",
        f"timestamp_millis({_MS} + copy) AS timestamp",
    )


def stored_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the events that are in the table before the batch."""
    return source_events(spark, sf_dir).where(_e() % 5 == 0).select(_uuid("8000", _e()).alias("id"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client per user group; group 3 is inactive and group 7 is missing."""
    group = (
        source_events(spark, sf_dir)
        .select((F.col("user_id") % 10).alias("g"))
        .distinct()
        .where("g <> 7")
    )
    return group.select(
        _uuid("8002", F.col("g")).alias("id"),
        F.concat(F.lit("key_"), F.col("g").cast("string")).alias("api_key"),
        F.concat(F.lit("Client "), F.col("g").cast("string")).alias("name"),
        (F.col("g") != 3).alias("active"),
        F.timestamp_millis(F.lit(1_700_000_000_000)).alias("created_at"),
    )


def request_log(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """REQUEST_LOG rows: one request per event and its retries."""
    sends = f"""explode(array_compact(array(
        struct(0L AS shift, 0L AS delay),
        IF(event_id % 17 = 0 AND duration_ms >= 2,
           struct({RETRIES['in flight']}L AS shift, duration_ms div 2 AS delay), NULL),
        IF(event_id % 13 = 0, struct({RETRIES['after finish']}L AS shift, duration_ms + 5000 AS delay), NULL),
        IF(event_id % 19 = 0, struct({RETRIES['at expiry']}L AS shift, duration_ms + 86400000 AS delay), NULL)
    ))) AS send"""
    body = _json("", "CASE WHEN event_id % 37 = 0 THEN 'x' ELSE event_type END", "value")
    return (
        spread(source_events(spark, sf_dir, streaming))
        .selectExpr("*", "1 + (event_id * 7919) % 6000 AS duration_ms")
        .selectExpr("*", sends)
        .selectExpr(
            "event_id + send.shift AS request_id",
            f"""{_MS} + send.delay + CASE event_id % 23 WHEN 0 THEN 300001 WHEN 1 THEN 300000
                WHEN 2 THEN -300000 WHEN 3 THEN -300001 ELSE 1000 END AS received_at_ms""",
            "CASE WHEN event_id % 31 <> 0 THEN concat('key_', CAST(user_id % 10 AS STRING)) END AS api_key",
            "concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS client_ip",
            f"CASE event_id % 29 WHEN 0 THEN NULL WHEN 1 THEN 'not-a-uuid' ELSE {_ID} END AS idempotency_key",
            "'POST' AS method",
            "CASE event_id % 53 WHEN 0 THEN '/metrics' WHEN 1 THEN '/health' ELSE '/v1/events' END AS route",
            f"CASE WHEN event_id % 47 = 0 THEN '{{\"deviceId\":' ELSE {body} END AS body",
            "duration_ms",
            "CASE WHEN event_id % 59 = 0 THEN 500 ELSE 202 END AS handler_status",
        )
    )


#: How the bodies of unusual requests differ, by event id modulo 12; others are plain.
UNUSUAL = {
    0: "concat('{\"deviceId\":\"', device, '\",\"eventType\":\"', event_type, '\",\"value\":1,\"timestamp\":', ms, ',\"pad\":\"', repeat('p', 10240), '\"}')",
    1: "concat('{\"deviceId\":\"', device, '\",\"eventType\":\"', event_type, '\",\"value\":1,\"timestamp\":', ms, '.5}')",
    2: "concat('{\"deviceId\":\"', device, '\",\"eventType\":\"', event_type, '\",\"value\":1,\"timestamp\":-', ms, '}')",
    3: "concat('{\"deviceId\":\"', device, '\",\"eventType\":\"', event_type, '\",\"value\":1,\"timestamp\":', ms, ',\"metadata\":null}')",
    4: "concat('{\"deviceId\":\"', device, '\",\"eventType\":\"', event_type, '\",\"value\":1,\"timestamp\":', ms, ',\"metadata\":{\"a\":[1],\"b\":\"x\",\"c\":null}}')",
    5: "concat('{\"deviceId\":\"', device, '\",\"eventType\":\"', event_type, '\",\"value\":1,\"timestamp\":', ms, ',\"metadata\":[1]}')",
    6: "''",
    7: "concat('{\"deviceId\":\"', device, '\",\"eventType\":\"', event_type, '\",\"value\":1,\"timestamp\":', ms, ',\"metadata\":{\"a\":1,\"b\":true}}')",
}
_PLAIN_BODY = "concat('{\"deviceId\":\"', device, '\",\"eventType\":\"', event_type, '\",\"value\":1,\"timestamp\":', ms, '}')"


def unusual_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REQUEST_LOG rows, one per event under a key of its own: bodies too large, fractions, bad metadata, nothing at all."""
    body = " ".join(f"WHEN {k} THEN {text}" for k, text in UNUSUAL.items())
    events = spread(source_events(spark, sf_dir)).selectExpr("*", f"CAST({_MS} AS STRING) AS ms", f"{_DEVICE} AS device")
    return events.selectExpr(
        "event_id AS request_id",
        "CAST(ms AS BIGINT) AS received_at_ms",
        "concat('key_', CAST(user_id % 3 AS STRING)) AS api_key",
        "'10.0.0.1' AS client_ip",
        f"{_ID} AS idempotency_key",
        "'POST' AS method",
        "'/v1/events' AS route",
        f"CASE event_id % 12 {body} ELSE {_PLAIN_BODY} END AS body",
        "5L AS duration_ms",
        "202 AS handler_status",
    )


def unusual_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPIC rows whose values are the unusual bodies, or null."""
    requests = unusual_requests(spark, sf_dir)
    return requests.select(
        "idempotency_key",
        F.col("client_ip").alias("key"),
        F.when(F.col("request_id") % 24 != 18, F.col("body")).alias("value"),
        F.col("request_id").alias("offset"),
    ).drop("idempotency_key")


#: Rows that one task writes to a file of a part.
PART_FILE_ROWS = 100_000


def in_parts(table: DataFrame, part: Column, parts: int, folder: str) -> str:
    """Write ``table`` below ``folder`` part by part, each younger than the one before and all in the same number of files.

    A file stream of ``folder/*`` that takes the returned number of files at a time takes a part in each micro-batch. The number
    follows the largest part, so that no task holds a part that grows with the table.
    """
    spark, held = table.sparkSession, table.withColumn("__part", part)
    rows = dict(map(tuple, held.groupBy("__part").count().collect()))
    files = max(1, *(-(-rows.get(k, 0) // PART_FILE_ROWS) for k in range(parts)))
    for k in range(parts):
        path = f"{folder}/{uuid.uuid4().hex}"
        held.where(F.col("__part") == k).drop("__part").repartition(files).write.parquet(path)
        # A task without rows writes no file: a small part is filled up with empty ones.
        for _ in range(files - len(spark.read.schema(table.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], table.schema).coalesce(1).write.mode("append").parquet(path)
    return str(files)
