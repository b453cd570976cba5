"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.text import is_uuid
from gaugeflow.materialize import written_table
from gaugeflow.operators import admission as adm
from gaugeflow.operators import live, rules
from gaugeflow.operators.clients import attach_client, upsert_clients_if_absent
from gaugeflow.operators.counters import batch_counters
from gaugeflow.operators.dedup import dedup_first, new_only
from gaugeflow.operators.idempotency import RESULT_COLUMNS, idempotency_outcomes, latest_runs
from gaugeflow.operators.lookup import device_type_lookup, latest
from gaugeflow.operators.parse import parse_events, with_event_time
from gaugeflow.operators.rate import rate_usage
from gaugeflow.operators.request_metrics import active_requests, duration_histogram, peak_requests, request_counts
from gaugeflow.operators.sequence import device_sequence
from gaugeflow.operators.storage_rules import split_dlq, stored_events
from gaugeflow.operators.window_stats import type_stats, window_stats
from gaugeflow.plans import inputs

Query = Callable[[SparkSession, str], DataFrame]

LATEST_N = 100
RATE_WINDOW_S, RATE_LIMIT = 86_400, 40
#: Where the request log is cut into two runs.
NEXT_RUN_MS = 1_705_104_000_000
LOOKUP = {
    "device_id": "00000000-0000-4000-8001-000000000007",
    "event_type": "click",
    "from_ms": 1_704_240_000_000,
    "to_ms": 1_706_140_800_000,
}


def _naive(column: str) -> F.Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


def _events_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.raw_events(spark, sf_dir).select(
        "id",
        F.col("deviceId").alias("device_id"),
        F.col("eventType").alias("event_type"),
        F.col("value").cast("double").alias("value"),
        "timestamp",
    )


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.request_log(spark, sf_dir).where(F.col("route") == "/v1/events")


def _dispositions(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    return adm.admit(event_requests(spark, sf_dir), inputs.clients(spark, sf_dir), carry=carry)


def _log_with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.request_log(spark, sf_dir).withColumn("status_code", F.col("handler_status"))


def _new_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = split_dlq(inputs.topic_messages(spark, sf_dir))
    batch = dedup_first(stored_events(good, "offset"), "id", ["offset"]).drop("offset")
    return new_only(batch, inputs.stored_before(spark, sf_dir))


def events_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_as_stored(spark, sf_dir)


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_events(inputs.topic_messages(spark, sf_dir)).select(
        "id", "deviceId", "eventType", "value", "timestamp", F.col("metadata")["k"].alias("metadata_k")
    )


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_time(inputs.raw_events(spark, sf_dir)).select("id", _naive("event_time"))


def sliding_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = window_stats(inputs.raw_events(spark, sf_dir))
    return stats.withColumns({c: _naive(c) for c in ("window_start", "window_end")})


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_stats(inputs.raw_events(spark, sf_dir))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_type_lookup(_events_as_stored(spark, sf_dir), **LOOKUP)


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_events_as_stored(spark, sf_dir), LATEST_N)


def client_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attach_client(inputs.request_log(spark, sf_dir), inputs.clients(spark, sf_dir))
    return found.select("request_id", "client_id", "client_name", "client_active")


def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.validation_errors(rules.validate(inputs.request_log(spark, sf_dir)))


def answer_columns(dispositions: DataFrame) -> DataFrame:
    fields = F.array_join(F.transform("errors", lambda issue: issue["field"]), ",")
    return dispositions.select(
        "request_id",
        "client_id",
        "client_name",
        "status_code",
        "reason",
        "source_request_id",
        F.coalesce(fields, F.lit("")).alias("error_fields"),
    )


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_columns(_dispositions(spark, sf_dir, "request_id"))


def disposition_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adm.disposition_tally(_dispositions(spark, sf_dir, "request_id"))


def publish_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = adm.publish_payload(_dispositions(spark, sf_dir, "idempotency_key", "body"))
    return payload.withColumn("metadata", F.to_json("metadata"))


def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adm.to_topic_records(adm.publish_payload(_dispositions(spark, sf_dir, "idempotency_key", "body")))


def ack_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adm.ack_records(adm.publish_payload(_dispositions(spark, sf_dir, "idempotency_key", "body")))


def idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.request_log(spark, sf_dir).select(
        "request_id", "received_at_ms", "idempotency_key", "duration_ms", "handler_status"
    )
    decided = idempotency_outcomes(log, eligible=is_uuid(F.col("idempotency_key")))
    return decided.select("request_id", *[c for c in RESULT_COLUMNS if c != "replay_response"])


def idempotency_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two runs; the second starts from the written state of the first."""
    log = inputs.request_log(spark, sf_dir).select(
        "request_id", "received_at_ms", "idempotency_key", "duration_ms", "handler_status"
    )
    allowed, before = is_uuid(F.col("idempotency_key")), F.col("received_at_ms") < NEXT_RUN_MS
    first = idempotency_outcomes(log.where(before), eligible=allowed)
    runs = written_table(latest_runs(first, alive_at_ms=NEXT_RUN_MS), "runs")
    second = idempotency_outcomes(log.where(~before), eligible=allowed, earlier=runs)
    return first.unionByName(second).select("request_id", *[c for c in RESULT_COLUMNS if c != "replay_response"])


def dlq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_dlq(inputs.topic_messages(spark, sf_dir))[1]


def store_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_batch(spark, sf_dir)


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_counters(inputs.topic_messages(spark, sf_dir), inputs.stored_before(spark, sf_dir))


def first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = split_dlq(inputs.topic_messages(spark, sf_dir))
    return dedup_first(stored_events(good, "offset"), "id", ["offset"]).select("id", "value", "offset")


def clients_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = inputs.source_events(spark, sf_dir).select((F.col("user_id") % 10).cast("string").alias("g")).distinct()
    new = group.select(
        F.concat(F.lit("00000000-0000-4000-8003-"), F.lpad("g", 12, "0")).alias("id"),
        F.concat(F.lit("key_"), "g").alias("api_key"),
        F.concat(F.lit("New "), "g").alias("name"),
        F.lit(True).alias("active"),
    )
    return upsert_clients_if_absent(new, inputs.clients(spark, sf_dir).drop("created_at"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_counts(_log_with_status(spark, sf_dir))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duration_histogram(_log_with_status(spark, sf_dir))


def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_requests(inputs.request_log(spark, sf_dir))


def peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_requests(inputs.request_log(spark, sf_dir))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = attach_client(inputs.request_log(spark, sf_dir), inputs.clients(spark, sf_dir))
    used = rate_usage(log.select("request_id", "received_at_ms", "client_id", "client_ip"), RATE_WINDOW_S, RATE_LIMIT)
    return used.select("request_id", "caller", "used", "limited")


def live_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_totals(inputs.raw_events(spark, sf_dir), inputs.CARD_STAND_INS)


def running_type_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.running_type_avg(inputs.raw_events(spark, sf_dir), inputs.CARD_STAND_INS)


def running_type_avg_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in two runs; the second starts from the written totals of the first."""
    events, before = inputs.raw_events(spark, sf_dir), F.col("timestamp") < NEXT_RUN_MS
    first, second = events.where(before), events.where(~before)
    totals = written_table(live.type_totals(first, inputs.CARD_STAND_INS), "type-totals")
    means = live.running_type_avg(first, inputs.CARD_STAND_INS)
    return means.unionByName(live.running_type_avg(second, inputs.CARD_STAND_INS, before=totals))


def admission_unusual(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = adm.admit(inputs.unusual_requests(spark, sf_dir), inputs.clients(spark, sf_dir), carry=("request_id",))
    return answer_columns(answered).drop("client_id", "client_name", "source_request_id")


def dlq_unusual(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = split_dlq(inputs.unusual_messages(spark, sf_dir).withColumn("key", F.col("offset").cast("string")))[1]
    return bad.select("key", "value", "reason")


def live_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_log_lines(inputs.raw_events(spark, sf_dir))


def trailing_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.raw_events(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    return live.trailing_chart(events, first_type=inputs.CARD_STAND_INS[0])


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = inputs.topic_messages(spark, sf_dir).select("key", "offset")
    return device_sequence(messages).select(F.col("key").alias("device_id"), "offset", "seq_no")


BATCH_QUERIES: dict[str, Query] = {
    "sliding_window_stats": sliding_window_stats,
    "type_stats": types,
    "events_scan": events_scan,
    "parse_events": parsed_events,
    "event_time": event_times,
    "device_type_lookup": lookup,
    "latest_events": latest_events,
    "client_lookup": client_lookup,
    "validation_errors": validation_errors,
    "admission": admission,
    "disposition_tally": disposition_tally,
    "publish_payload": publish_payload,
    "topic_records": topic_records,
    "ack_records": ack_records,
    "idempotency_outcomes": idempotency,
    "idempotency_incremental": idempotency_incremental,
    "dlq_records": dlq_records,
    "store_insert_if_absent": store_insert_if_absent,
    "pipeline_counters": counters,
    "dedup_first": first_deliveries,
    "clients_insert_if_absent": clients_insert_if_absent,
    "request_counts": counts,
    "request_latency_histogram": latency_histogram,
    "active_requests": in_flight,
    "active_requests_peak": peak,
    "rate_usage": usage,
    "live_cards": live_cards,
    "running_type_avg": running_type_avg,
    "running_type_avg_incremental": running_type_avg_incremental,
    "admission_unusual": admission_unusual,
    "dlq_unusual": dlq_unusual,
    "live_log_lines": live_log_lines,
    "trailing_chart": trailing_chart,
    "device_sequence": sequence,
}
