"""Idempotency outcomes on a stream of requests, from keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeflow.constants import LOCK_SECONDS, RESPONSE_TTL_SECONDS
from gaugeflow.operators.idempotency import EXECUTE, REPLAY, RUN, decide_one
from gaugeflow.streaming.keyed import ROW, arrived, travelling, unpacked

OUTCOME = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("source_request_id", T.LongType()),
        T.StructField("replay_status", T.IntegerType()),
        T.StructField("replay_response", T.StringType()),
    ]
)


REQUEST = "__request"
#: Groups over which requests without idempotency state are dealt.
STATELESS_GROUPS = 1024
#: Groups of keys, one state row and one Python call a micro-batch each: a call costs as much as many decisions.
KEY_GROUPS = 262_144

#: The latest runs of the keys of a group, one list per field, and when each is dropped.
RUNS = T.StructType(
    [
        T.StructField("key", T.ArrayType(T.StringType())),
        *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in RUN.fields),
        T.StructField("until", T.ArrayType(T.LongType())),
    ]
)


def _on_requests(lock_ms: int, ttl_ms: int):
    outputs = [ROW, *OUTCOME.fieldNames()]
    fields = RUN.fieldNames()

    def on_requests(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0].startswith("row:"):
            # Requests that touch no state pass as they come, however many.
            for pdf in batches:
                request_ids = pd.Series([json.loads(request)["request_id"] for request in pdf[REQUEST]], index=pdf.index, dtype=object)
                passed = pd.DataFrame({ROW: pdf[ROW], "request_id": request_ids})
                yield passed.assign(**dict.fromkeys(OUTCOME.fieldNames()[1:]))
            return
        # Plain lists: a key has few requests, where pandas operations would cost more than the decision.
        requests = []
        if not state.hasTimedOut:
            requests = [(json.loads(request), row) for pdf in batches for request, row in zip(pdf[REQUEST].tolist(), pdf[ROW].tolist(), strict=True)]
        # Null ids first, as in the table.
        requests.sort(key=lambda r: (r[0]["start"], r[0]["request_id"] is not None, r[0]["request_id"] or 0))
        runs = {}
        if state.exists:
            runs = {of: (dict(zip(fields, run, strict=True)), until) for of, *run, until in zip(*state.get, strict=True)}
        watermark = state.getCurrentWatermarkMs()
        rows, last = [], {}
        for request, row in requests:
            of, request_id, start = request["key"], request["request_id"], request["start"]
            run = runs[of][0] if of in runs else None
            outcome = decide_one(run, start, lock_ms, ttl_ms)
            if outcome == EXECUTE:
                run = {name: request[name] for name in fields}
                runs[of] = (run, None)
            replayed = (run["status"], run["response"]) if outcome == REPLAY else (None, None)
            rows.append((row, request_id, outcome, run["request_id"], *replayed))
            last[of] = (start, request["arrived"])
        for of, (start, arrived_ms) in last.items():
            run = runs[of][0]
            # The run can matter until its response or its lock has expired, counted from its latest request.
            until = max(run["start"] + lock_ms, (run["end"] or 0) + ttl_ms)
            runs[of] = (run, max(arrived_ms + max(until - start, 1), watermark + 1))
        kept = [(of, *run.values(), until) for of, (run, until) in runs.items() if of in last or until >= watermark]
        if kept:
            state.update(tuple(list(values) for values in zip(*kept, strict=True)))
            state.setTimeoutTimestamp(max(min(row[-1] for row in kept), watermark + 1))
        else:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=outputs, dtype=object)

    return on_requests


def stream_idempotency_outcomes(
    requests: DataFrame,
    lock_s: int = LOCK_SECONDS,
    ttl_s: int = RESPONSE_TTL_SECONDS,
    *,
    status_col: str = "handler_status",
    response_col: str | None = None,
    eligible: Column | None = None,
    carry: Sequence[str] = (),
    key_groups: int = KEY_GROUPS,
) -> DataFrame:
    """Outcome of each request of a stream, as ``idempotency_outcomes`` gives for a table, with the columns ``carry``.

    Requests without a key give no row; with ``eligible`` every request does, those that are not eligible or have no key or
    time with a null outcome. The state of a key is its latest run. It is dropped by the clock, as long after the key's latest
    request as the response had still to live. The watermark follows the arrival of requests, not their times, so none is late and
    every request gets an answer. Requests are taken in order within a micro-batch; one that comes in a later micro-batch
    than its successors is decided from the state they left.

    Keys are dealt by hash over ``key_groups`` groups. A micro-batch makes one Python call for each group that it has requests
    of, not one for each key, and reads and writes the runs of these groups; it holds the requests of one group at once. Choose the groups once for a
    checkpoint, so that a group has at most some hundred live keys: fewer make a small micro-batch read more beside its own
    keys, more cost calls.
    """
    start = F.col("received_at_ms").cast("long")
    response = F.col(response_col) if response_col else F.lit(None)
    keyed = F.col("idempotency_key").isNotNull() & start.isNotNull()
    group = F.concat(F.lit("key:"), F.pmod(F.xxhash64("idempotency_key"), F.lit(key_groups)).cast("string"))
    if eligible is None:
        requests = requests.where(keyed)
    else:
        dealt = F.pmod(F.xxhash64("request_id", "received_at_ms", "idempotency_key"), F.lit(STATELESS_GROUPS)).cast("string")
        group = F.when(keyed & F.coalesce(eligible, F.lit(False)), group).otherwise(F.concat(F.lit("row:"), dealt))
    carry = [c for c in carry if c != "request_id"]
    # One text for all that a decision takes: a column costs each call as much as many rows, and pandas is not exact on longs beside nulls.
    request = F.struct(
        F.col("idempotency_key").alias("key"),
        F.col("request_id").cast("long").alias("request_id"),
        start.alias("start"),
        (start + F.col("duration_ms")).cast("long").alias("end"),
        F.col(status_col).cast("int").alias("status"),
        response.cast("string").alias("response"),
        F.unix_millis(F.current_timestamp()).alias("arrived"),
    )
    runs = requests.select(
        group.alias("__group"),
        F.to_json(request, {"ignoreNullFields": "false"}).alias(REQUEST),
        F.current_timestamp().alias("__arrived_at"),
        travelling(carry) if carry else F.lit(None).cast("string").alias(ROW),
    ).withWatermark("__arrived_at", "1 second")
    schema = T.StructType([T.StructField(ROW, T.StringType()), *OUTCOME.fields])
    found = runs.groupBy("__group").applyInPandasWithState(
        _on_requests(lock_s * 1000, ttl_s * 1000), schema, RUNS, "append", GroupStateTimeout.EventTimeTimeout
    )
    if not carry:
        return found.select(*OUTCOME.fieldNames())
    return unpacked(found, requests, carry).select(*OUTCOME.fieldNames(), *arrived(carry))
