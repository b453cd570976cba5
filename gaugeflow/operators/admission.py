"""Admission of event requests: the first failing rule decides, then idempotency, then validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.jsontypes import as_number, as_text, json_documents
from gaugeflow.functions.text import is_uuid
from gaugeflow.operators import rules
from gaugeflow.operators.clients import attach_client
from gaugeflow.operators.idempotency import (
    CONFLICT,
    EXECUTE,
    MAX_KEY_ROWS,
    REPLAY,
    SEGMENT_ROWS,
    idempotency_outcomes,
    large_keys,
)
from gaugeflow.operators.ordered import MAX_GROUP_ROWS
from gaugeflow.operators.rate import rate_usage
from gaugeflow.schemas import DISPOSITION, ISSUES

ACCEPTED = 202
# What the idempotency step reads of a request.
STATE_COLUMNS = ("request_id", "received_at_ms", "idempotency_key", "duration_ms")


def _refusal(status: int, reason: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))


def _before_limit(body: Column, kind: Column, api_key: Column) -> Column:
    return (
        F.when(~rules.is_body_small_enough(body), _refusal(413, "payload_too_large"))
        .when(~rules.is_parseable(kind), _refusal(400, "malformed_json"))
        .when(~rules.is_present(api_key), _refusal(401, "missing_api_key"))
        .when(~rules.is_known(F.col("client_id")), _refusal(401, "invalid_api_key"))
        .when(~rules.is_active(F.col("client_active")), _refusal(401, "deactivated_api_key"))
    )


def _after_limit(key: Column) -> Column:
    return F.when(~rules.is_present(key), _refusal(400, "missing_idempotency_key")).when(
        ~is_uuid(key), _refusal(400, "invalid_idempotency_key")
    )


def _limit(checked: DataFrame, window_s: int, limit: int, max_group_rows: int) -> DataFrame:
    """Only requests that reach the limiter are counted by it."""
    reached = rate_usage(checked.where(F.col("refusal").isNull()), window_s, limit, max_group_rows)
    return (
        reached.withColumn("refusal", F.when(F.col("limited"), _refusal(429, "rate_limited")))
        .select(*checked.columns)
        .unionByName(checked.where(F.col("refusal").isNotNull()))
    )


def before_limit(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """``requests`` with their client, violations and ``refusal`` (status, reason) by the rules before the rate limit."""
    return rules.validate(attach_client(requests, clients)).withColumn(
        "refusal", _before_limit(F.col("body"), F.col("body_kind"), F.col("api_key"))
    )


def gate(checked: DataFrame, columns: Sequence[str], limited: Column | None = None) -> DataFrame:
    """``columns``, what the idempotency step reads, and the refusal by any rule before it. ``limited`` marks calls over the limit."""
    refusal = F.col("refusal")
    if limited is not None:
        refusal = F.coalesce(refusal, F.when(limited, _refusal(429, "rate_limited")))
    return checked.withColumn("refusal", F.coalesce(refusal, _after_limit(F.col("idempotency_key")))).select(
        *columns,
        *[c for c in STATE_COLUMNS if c not in columns],
        "client_id",
        "client_name",
        "refusal",
        F.when(F.size("errors") > 0, 400).otherwise(F.coalesce("handler_status", F.lit(ACCEPTED))).alias("run_status"),
        F.to_json("errors").alias("run_errors"),
    )


def answers(decided: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``DISPOSITION`` rows of gated requests whose idempotency outcome is known."""
    outcome, status, finished = F.col("outcome"), F.col("run_status"), F.col("duration_ms").isNotNull()
    code = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal.status"))
        .when(outcome == CONFLICT, 409)
        .when(outcome == REPLAY, F.col("replay_status"))
        .when(finished, status)
    )
    invalid = F.col("run_errors") != "[]"
    reason = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal.reason"))
        .when(outcome == CONFLICT, "in_progress")
        .when(outcome == REPLAY, "replayed")
        .when(~finished, "unfinished")
        .when(status == ACCEPTED, "accepted")
        .when(invalid, "validation_failed")
        .otherwise("handler_failed")
    )
    text = F.when((outcome == EXECUTE) & finished, F.col("run_errors")).when(outcome == REPLAY, F.col("replay_response"))
    errors = F.from_json(text, ISSUES)
    return decided.select(
        *columns,
        "client_id",
        "client_name",
        code.cast("int").alias("status_code"),
        reason.alias("reason"),
        F.when(outcome.isNotNull(), F.col("source_request_id")).alias("source_request_id"),
        F.filter(errors, lambda issue: issue.isNotNull()).cast(DISPOSITION["errors"].dataType).alias("errors"),
    )


def admit(
    requests: DataFrame,
    clients: DataFrame,
    *,
    rate_limit: tuple[int, int] | None = None,
    carry: Sequence[str] | None = None,
    earlier: DataFrame | None = None,
    max_key_rows: int = MAX_KEY_ROWS,
    segment_rows: int = SEGMENT_ROWS,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The answer to each request, as ``DISPOSITION`` rows.

    Order: body size and JSON, API key, ``rate_limit`` (window seconds, limit; off by default), idempotency
    key, earlier runs of the key, validation. Idempotency comes before validation and keeps 4xx answers too,
    so a corrected body under the same key gets the old 400 again.

    One shuffle on the idempotency key; the clients are broadcast while small. ``carry`` names the request
    columns to keep, all by default: without the body, a count of answers shuffles a fraction of the bytes.
    ``earlier`` are the runs of keys before these requests, as ``latest_runs`` gives them for ``ran(answers)``.
    """
    columns = list(requests.columns if carry is None else carry)
    checked = before_limit(requests, clients)
    if rate_limit is not None:
        checked = _limit(checked, *rate_limit, max_group_rows)
    decided = idempotency_outcomes(
        gate(checked, columns),
        status_col="run_status",
        response_col="run_errors",
        eligible=F.col("refusal").isNull(),
        earlier=earlier,
        large=large_keys(requests.where(is_uuid(F.col("idempotency_key"))), max_key_rows),
        segment_rows=segment_rows,
    )
    return answers(decided, columns)


def ran(dispositions: DataFrame) -> DataFrame:
    """Requests that executed, with ``outcome`` and ``run_errors``, from which ``latest_runs`` takes the state of each key."""
    executed = dispositions.where(F.col("reason").isin("accepted", "validation_failed", "handler_failed", "unfinished"))
    return executed.withColumns({"outcome": F.lit(EXECUTE), "run_errors": F.to_json("errors")})


def accepted(dispositions: DataFrame) -> DataFrame:
    """Requests whose event is published; a replayed answer publishes nothing."""
    return dispositions.where(F.col("reason") == "accepted")


def publish_payload(dispositions: DataFrame) -> DataFrame:
    """Event of each accepted request: the idempotency key as ``id`` and the declared body fields.

    Unknown body fields are dropped. ``metadata`` stays a variant, so that its values keep their JSON types.
    """
    doc = F.col("doc")
    return (
        accepted(dispositions)
        .withColumn("doc", F.element_at(json_documents(F.col("body"), rules.BODY_FIELDS), 1))
        .select(
            F.col("idempotency_key").alias("id"),
            as_text(doc["deviceId"]).alias("deviceId"),
            as_text(doc["eventType"]).alias("eventType"),
            as_number(doc["value"]).alias("value"),
            as_number(doc["timestamp"]).cast("long").alias("timestamp"),
            doc["metadata"].alias("metadata"),
        )
    )


def to_topic_records(payload: DataFrame) -> DataFrame:
    """``(key, value)`` records keyed by device; an absent ``metadata`` is left out of the JSON."""
    fields = ("id", "deviceId", "eventType", "value", "timestamp", "metadata")
    return payload.select(F.col("deviceId").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def ack_records(payload: DataFrame) -> DataFrame:
    """What the sender of an accepted event is told."""
    return payload.select("id", "deviceId", "timestamp")


def disposition_tally(dispositions: DataFrame) -> DataFrame:
    """Answers per status: 202, 409, 400, 401 or other."""
    code = F.col("status_code")
    bucket = F.when(code.isin(202, 409, 400, 401), code.cast("string")).otherwise("other")
    return dispositions.groupBy(bucket.alias("outcome")).agg(F.count(F.lit(1)).alias("requests"))
