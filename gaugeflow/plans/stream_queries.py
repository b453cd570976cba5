"""Registered streaming queries: the test table as a stream, run to its end, the written result read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.text import is_uuid
from gaugeflow.materialize import shared_dir
from gaugeflow.operators.clients import attach_client
from gaugeflow.operators.parse import delivered_events
from gaugeflow.operators.request_metrics import batch_duration_histogram
from gaugeflow.operators.window_stats import pane_window_stats, window_stats
from gaugeflow.plans import inputs
from gaugeflow.plans.queries import NEXT_RUN_MS, RATE_LIMIT, RATE_WINDOW_S, answer_columns, event_requests
from gaugeflow.schemas import DLQ
from gaugeflow.sources.readers import read_events, read_requests
from gaugeflow.sources.writers import start_stream
from gaugeflow.streaming.admission import admitted, fed, published, run_admission
from gaugeflow.streaming.aggregate import start_live_totals, write_window_stats
from gaugeflow.streaming.dedup import first_deliveries
from gaugeflow.streaming.idempotency import stream_idempotency_outcomes
from gaugeflow.streaming.rate import stream_rate_usage
from gaugeflow.streaming.storage import batch_log, run_storage

ONCE = {"availableNow": True}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/gaugeflow/stream-{name}-{uuid.uuid4().hex}"


def _finished(df: DataFrame, name: str) -> DataFrame:
    """Run an append stream to the end of its input and read what it wrote."""
    folder = _folder(df.sparkSession, name)
    start_stream(df, f"{folder}/out", f"{folder}/checkpoint", trigger=ONCE).awaitTermination()
    return _written(df.sparkSession, df.schema, f"{folder}/out")


def _written(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = window_stats(inputs.raw_events(spark, sf_dir, streaming=True))
    folder = _folder(spark, "windows")
    write_window_stats(stats, f"{folder}/out", f"{folder}/checkpoint", trigger=ONCE).awaitTermination()
    written = _written(spark, stats.schema, f"{folder}/out")
    return written.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _stored(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark, "storage")
    messages = inputs.topic_messages(spark, sf_dir, streaming=True)
    run_storage(messages, f"{folder}/events", f"{folder}/dlq", f"{folder}/checkpoint", ONCE).awaitTermination()
    return folder


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, f"{_stored(spark, sf_dir)}/events").drop("created_at")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, DLQ, f"{_stored(spark, sf_dir)}/dlq").select(*DLQ.fieldNames())


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals and redeliveries of the earlier events, then those of the later ones, in a micro-batch each."""
    folder = _folder(spark, "deliveries")
    messages = inputs.topic_messages(spark, sf_dir)
    later = (F.unix_millis("timestamp") >= NEXT_RUN_MS).cast("int")
    again = (F.col("offset") >= inputs.RETRIES["in flight"]).cast("int")
    files = inputs.in_parts(messages, 2 * later + again, 4, f"{folder}/in")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
    found = _finished(first_deliveries(delivered_events(stream)), "dedup")
    metadata = F.col("metadata")["k"].alias("metadata_k")
    return found.select("id", "deviceId", "eventType", "value", "timestamp", metadata, "partition", "offset")


#: Events of an id divisible by this come a part later than their time has it.
LATE_EVERY, LATE_DELAY = 7, "2 days"
LATE_CUTS_MS = (1_704_700_000_000, NEXT_RUN_MS, 1_705_900_000_000)


def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in four parts by time, some a part late; a window keeps a late event if the watermark has not passed its end."""
    folder = _folder(spark, "late")
    events = inputs.raw_events(spark, sf_dir).drop("metadata")
    part = sum(((F.col("timestamp") >= cut).cast("int") for cut in LATE_CUTS_MS), F.lit(0))
    late = (F.substring("id", -12, 12).cast("long") % LATE_EVERY == 0).cast("int")
    files = inputs.in_parts(events, F.least(part + late, F.lit(len(LATE_CUTS_MS))), len(LATE_CUTS_MS) + 1, f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
    stats = window_stats(stream, watermark=LATE_DELAY)
    write_window_stats(stats, f"{folder}/out", f"{folder}/checkpoint", trigger=ONCE).awaitTermination()
    written = _written(spark, stats.schema, f"{folder}/out")
    return written.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def pane_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pane_window_stats(inputs.raw_events(spark, sf_dir, streaming=True))
    folder = _folder(spark, "panes")
    write_window_stats(stats, f"{folder}/out", f"{folder}/checkpoint", trigger=ONCE).awaitTermination()
    written = _written(spark, stats.schema, f"{folder}/out")
    return written.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log in four parts by time, a micro-batch each."""
    folder = _folder(spark, "usage")
    log = attach_client(inputs.request_log(spark, sf_dir), inputs.clients(spark, sf_dir))
    calls = log.select("request_id", "received_at_ms", "client_id", "client_ip")
    part = sum(((F.col("received_at_ms") >= cut).cast("int") for cut in LATE_CUTS_MS), F.lit(0))
    files = inputs.in_parts(calls, part, len(LATE_CUTS_MS) + 1, f"{folder}/in")
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
    used = _finished(stream_rate_usage(stream, RATE_WINDOW_S, RATE_LIMIT), "usage")
    return used.select("request_id", "caller", "used", "limited")


def idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.request_log(spark, sf_dir, streaming=True).where(is_uuid(F.col("idempotency_key")))
    return _finished(stream_idempotency_outcomes(log), "idempotency").drop("replay_response")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"cards_{uuid.uuid4().hex}"
    events = inputs.raw_events(spark, sf_dir, streaming=True)
    start_live_totals(events, name, inputs.CARD_STAND_INS, trigger=ONCE).awaitTermination()
    return spark.table(name)


def _gateway(spark: SparkSession, sf_dir: str) -> str:
    """The request log comes in four parts, a micro-batch each; after the second the gateway stops and goes on from its checkpoint."""
    folder = _folder(spark, "admission")
    log, clients = event_requests(spark, sf_dir), inputs.clients(spark, sf_dir)
    part = sum(((F.col("received_at_ms") >= cut).cast("int") for cut in LATE_CUTS_MS), F.lit(0))
    for first in (0, 2):
        files = inputs.in_parts(log, part - first, 2, f"{folder}/log")
        requests = read_requests(spark, f"{folder}/log/*", streaming=True, maxFilesPerTrigger=files)
        run_admission(requests, clients, folder, f"{folder}/checkpoint", trigger=ONCE).awaitTermination()
    return folder


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_columns(admitted(spark, _gateway(spark, sf_dir)))


def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, _gateway(spark, sf_dir))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fed(spark, _gateway(spark, sf_dir))


def batch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write times of the storage consumer's batches, how many fell under each bound left out: times differ from run to run."""
    folder = _folder(spark, "batches")
    messages = inputs.topic_messages(spark, sf_dir)
    files = inputs.in_parts(messages.drop("topic"), (F.col("offset") >= inputs.RETRIES["in flight"]).cast("int"), 2, f"{folder}/in")
    stream = spark.readStream.schema(messages.drop("topic").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
    run_storage(stream, f"{folder}/events", f"{folder}/dlq", f"{folder}/checkpoint", ONCE, log_path=f"{folder}/log").awaitTermination()
    log = batch_log(spark, f"{folder}/log")
    counted = log.agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))
    return batch_duration_histogram(log).crossJoin(counted).select("le", "duration_count", "processed", "failed")


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_window_stats": windows,
    "stream_store_events": stored,
    "stream_dlq": dead_letters,
    "stream_dedup": deliveries,
    "stream_idempotency": idempotency,
    "stream_live_cards": cards,
    "stream_admission": admission,
    "stream_topic_records": topic_records,
    "stream_live_feed": feed,
    "stream_rate_usage": usage,
    "stream_late_windows": late_windows,
    "stream_window_stats_panes": pane_windows,
    "stream_batch_histogram": batch_histogram,
}
