"""Requests per caller in a trailing window, on a stream."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeflow.constants import RATE_LIMIT, RATE_WINDOW_SECONDS
from gaugeflow.operators.rate import caller
from gaugeflow.streaming.keyed import ROW, arrived, travelling, unpacked

#: Time buckets of a caller in order: a millisecond and its requests.
RING = T.StructType([T.StructField("at", T.ArrayType(T.LongType())), T.StructField("requests", T.ArrayType(T.LongType()))])


def _on_calls(window_ms: int):
    def on_calls(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls = [row for pdf in batches for row in zip(*(pdf[n].tolist() for n in ("__at", "__seq", "__arrived", ROW)), strict=True)]
        calls.sort(key=lambda row: (row[0], row[1]))
        at, requests = (list(x) for x in state.get) if state.exists else ([], [])
        count = dict(zip(at, requests))
        # `used` is the sum over the buckets from `first` on; it changes only where buckets enter or leave.
        first, used, reached = 0, 0, None
        rows = []
        for now, _, _, row in calls:
            if reached is None or now < reached or len(at) and at[-1] > now:
                # The first call, and one that comes after later ones: counted anew.
                first = bisect_left(at, now - window_ms)
                used = sum(count[t] for t in at[first : bisect_right(at, now)])
            if now not in count:
                insort(at, now)
                count[now] = 0
            count[now] += 1
            used += 1
            while at[first] < now - window_ms:
                used -= count[at[first]]
                first += 1
            reached = now
            rows.append((row, key[0], used))
        latest = at[-1]
        kept = at[bisect_left(at, latest - window_ms) :]
        state.update((kept, [count[t] for t in kept]))
        state.setTimeoutTimestamp(max(calls[-1][2] + window_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[ROW, "caller", "used"], dtype=object)

    return on_calls


def stream_rate_usage(
    requests: DataFrame, window_s: int = RATE_WINDOW_SECONDS, limit: int = RATE_LIMIT
) -> DataFrame:
    """Add ``caller``, ``used`` and ``limited`` to each request of a stream, as ``rate_usage`` does for a table.

    The state of a caller are the buckets of its last ``window_s`` seconds, one per millisecond that had requests: at most
    as many as the window has milliseconds. It is dropped by the clock when the window has passed without a request. Requests of
    a micro-batch are taken in (time, request id) order; one that comes in a later micro-batch than its successors counts what is
    left of its window, and later ones that were answered already stay as they are. Requests without a time are left out.
    """
    columns = requests.columns
    calls = (
        requests.where(F.col("received_at_ms").isNotNull())
        .select(
            caller(F.col("client_id"), F.col("client_ip")).alias("__caller"),
            F.col("received_at_ms").cast("long").alias("__at"),
            F.coalesce(F.col("request_id").cast("long"), F.lit(-1)).alias("__seq"),
            F.current_timestamp().alias("__arrived_at"),
            F.unix_millis(F.current_timestamp()).alias("__arrived"),
            travelling(columns),
        )
        .withWatermark("__arrived_at", "1 second")
    )
    added = [T.StructField("caller", T.StringType()), T.StructField("used", T.LongType())]
    counted = calls.groupBy("__caller").applyInPandasWithState(
        _on_calls(window_s * 1000),
        T.StructType([T.StructField(ROW, T.StringType()), *added]),
        RING,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return unpacked(counted, requests, columns).select(*arrived(columns), "caller", "used", (F.col("used") > limit).alias("limited"))
