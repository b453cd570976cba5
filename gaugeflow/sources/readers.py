"""Sources. Formats are parameters: a broker or lake format is used where its connector is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.constants import RAW_TOPIC
from gaugeflow.functions.eventtime import event_time
from gaugeflow.schemas import CLIENT, EVENT_DATE, REQUEST_LOG, STORED_EVENT


def read_raw_stream(
    spark: SparkSession,
    fmt: str = "kafka",
    path_or_topic: str = RAW_TOPIC,
    starting: str = "latest",
    **options: str,
) -> DataFrame:
    """Stream of raw messages with ``key`` and ``value`` text columns.

    ``kafka`` subscribes to a topic; by default it skips what was there before the first start.
    ``json`` reads files of one message per line, ``parquet`` files with ``key`` and ``value``; a file stream
    has no "latest" and always reads what is there. ``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger`` in
    ``options`` bound a micro-batch.
    """
    reader = spark.readStream.format("text" if fmt == "json" else fmt).options(**options)
    if fmt == "kafka":
        return (
            reader.option("subscribe", path_or_topic)
            .option("startingOffsets", starting)
            .load()
            .withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})
        )
    if fmt == "json":
        lines = reader.schema("value string").load(path_or_topic)
        return lines.select(F.lit(None).cast("string").alias("key"), "value")
    return reader.schema("key string, value string").load(path_or_topic)


def read_clients(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The clients table, from files or (``fmt="jdbc"``, ``path`` the table name) a database."""
    if fmt == "jdbc":
        loaded = spark.read.format("jdbc").options(dbtable=path, **options).load()
        return loaded.select(*[F.col(f.name).cast(f.dataType) for f in CLIENT])
    return spark.read.format(fmt).options(**options).schema(CLIENT).load(path)


def read_requests(
    spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet", **options: str
) -> DataFrame:
    """The request log, as a table or as a stream of its files."""
    reader = spark.readStream if streaming else spark.read
    return reader.format(fmt).options(**options).schema(REQUEST_LOG).load(path)


def read_events(spark: SparkSession, path: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """The stored events, optionally from ``from_ms`` up to but not including ``to_ms``.

    A range opens the directories of its dates only; events whose time is no date are in none.
    """
    layout = T.StructType([*STORED_EVENT.fields, T.StructField("batch_id", T.LongType()), T.StructField(EVENT_DATE, T.DateType())])
    events = spark.read.schema(layout).parquet(path)
    day = lambda ms: F.to_date(event_time(F.lit(ms).cast("long")))
    if from_ms is not None:
        events = events.where((F.col(EVENT_DATE) >= day(from_ms)) & (F.col("timestamp") >= from_ms))
    if to_ms is not None:
        events = events.where((F.col(EVENT_DATE) <= day(to_ms)) & (F.col("timestamp") < to_ms))
    return events.select(*STORED_EVENT.fieldNames())
