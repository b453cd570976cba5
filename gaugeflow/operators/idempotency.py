"""Retries under one idempotency key: execute, conflict or replay.

Let x be the latest executing request of a key, started at s, finished at e (or unfinished). A request at t

* executes when there is no x;
* conflicts while x runs and its lock of ``lock_s`` seconds holds; executes once the lock has expired;
* replays the response of x for ``ttl_s`` seconds after e when its status was 200-499; executes later;
* executes when x ended with another status.

Each decision depends on the latest *executing* request, not on the previous one, so requests of a key are
folded in (time, request id) order. Keys with up to ``max_key_rows`` requests are folded as one array. A key
with more is cut into consecutive segments; see ``_large_keys``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.constants import LOCK_SECONDS, RESPONSE_TTL_SECONDS
from gaugeflow.materialize import written_table
from gaugeflow.operators.ordered import SEGMENT, LargeGroups, large_groups, range_segments

EXECUTE, CONFLICT, REPLAY = "EXECUTE", "CONFLICT", "REPLAY"
MAX_KEY_ROWS = 4_096
SEGMENT_ROWS = 2_000_000

RUN = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("response", T.StringType()),
    ]
)


def decide(run: Column, at_ms: Column, lock_ms: int, ttl_ms: int) -> Column:
    """Outcome of a request at ``at_ms`` given ``run``, the latest executing request (null if none)."""
    running = run["end"].isNull() | (at_ms < run["end"])
    return (
        F.when(run["start"].isNull(), EXECUTE)
        .when(running & (at_ms - run["start"] < lock_ms), CONFLICT)
        .when(running, EXECUTE)
        .when(run["status"].between(200, 499) & (at_ms - run["end"] < ttl_ms), REPLAY)
        .otherwise(EXECUTE)
    )


def _outcome_columns(row: Column, outcome: Column, run: Column) -> list[Column]:
    executes = outcome == EXECUTE
    return [
        outcome.alias("outcome"),
        F.when(executes, row["__run"]["request_id"]).otherwise(run["request_id"]).alias("source_request_id"),
        F.when(outcome == REPLAY, run["status"]).alias("replay_status"),
        F.when(outcome == REPLAY, run["response"]).alias("replay_response"),
    ]


RESULT_COLUMNS = ("outcome", "source_request_id", "replay_status", "replay_response")


def _fold_small_keys(df: DataFrame, lock_ms: int, ttl_ms: int, earlier: DataFrame | None = None) -> DataFrame:
    """Fold each key's requests as one sorted array; a row that is not eligible is a group of its own.

    ``earlier`` (__key, __earlier) joins on the column that the requests were grouped by: they are not shuffled again.
    """
    columns = [c for c in df.columns if not c.startswith("__")]
    row = F.struct(
        F.col("__run.start").alias("at"), F.col("__run.request_id").alias("seq"), *columns, "__run", "__eligible"
    )
    of_key = F.concat(F.lit("key:"), "__key")
    # Rows without an id, however many, are told apart by their place.
    place = F.concat(F.lit("place:"), F.monotonically_increasing_id().cast("string"))
    alone_id = F.coalesce(F.concat(F.lit("row:"), F.col("__run.request_id").cast("string")), place)
    grouped = df.groupBy(F.coalesce(of_key, alone_id).alias("__group")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    if earlier is None:
        grouped = grouped.withColumn("__earlier", F.lit(None).cast(RUN))
    else:
        grouped = grouped.join(earlier.select(of_key.alias("__group"), "__earlier"), "__group", "left")
    rows_type = grouped.schema["rows"].dataType.elementType
    done_type = T.ArrayType(
        T.StructType(
            [
                *[T.StructField(c, rows_type[c].dataType) for c in columns],
                T.StructField("outcome", T.StringType()),
                T.StructField("source_request_id", T.LongType()),
                T.StructField("replay_status", T.IntegerType()),
                T.StructField("replay_response", T.StringType()),
            ]
        )
    )
    start = F.struct(F.col("__earlier").cast(RUN).alias("run"), F.array().cast(done_type).alias("done"))

    def step(acc: Column, r: Column) -> Column:
        outcome = F.when(r["__eligible"], decide(acc["run"], r["at"], lock_ms, ttl_ms))
        done = F.struct(*[r[c].alias(c) for c in columns], *_outcome_columns(r, outcome, acc["run"]))
        return F.struct(
            F.when(outcome == EXECUTE, r["__run"]).otherwise(acc["run"]).alias("run"),
            F.concat(acc["done"], F.array(done)).alias("done"),
        )

    def alone(r: Column) -> Column:
        outcome = F.when(r["__eligible"], EXECUTE)
        return F.struct(*[r[c].alias(c) for c in columns], *_outcome_columns(r, outcome, F.lit(None).cast(RUN)))

    folded = F.aggregate("rows", start, step, lambda acc: acc["done"])
    # Most keys have one request, which executes.
    single = F.transform("rows", alone).cast(done_type)
    return grouped.select(F.inline(F.when((F.size("rows") == 1) & F.col("__earlier").isNull(), single).otherwise(folded)))


# --- keys with very many requests --------------------------------------------------------------------------


def next_executing(
    at: np.ndarray, end: np.ndarray, finished: np.ndarray, cached: np.ndarray, lock_ms: int, ttl_ms: int
) -> np.ndarray:
    """For each request, were it executing: index of the next one to execute, ``len(at)`` if none is left.

    ``at`` is sorted, but for a first row that may be later than others: a run from before these requests.
    ``cached`` marks runs that finished with a status that is replayed.
    """
    n = len(at)
    ordered = np.minimum.accumulate(at[::-1])[::-1]
    after = np.arange(n) + 1
    free = np.where(finished, np.minimum(end, at + lock_ms), at + lock_ms)
    nxt = np.maximum(after, np.searchsorted(ordered, free, side="left"))
    # The candidate may come after x finished, where its response is replayed.
    lands = np.append(at, np.iinfo(np.int64).max)[nxt]
    replayed = cached & (lands >= end)
    return np.where(replayed, np.maximum(after, np.searchsorted(ordered, end + ttl_ms, side="left")), nxt)


def last_executing(nxt: np.ndarray) -> np.ndarray:
    """For each request, were it executing: the last one to execute (pointer doubling)."""
    n = len(nxt)
    jump = np.where(nxt >= n, np.arange(n), nxt)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    at = pdf["start"].to_numpy(np.int64)
    finished = pdf["end"].notna().to_numpy()
    end = pdf["end"].fillna(0).to_numpy(np.int64)
    status = pdf["status"].fillna(0).to_numpy(np.int64)
    return at, end, finished, finished & (status >= 200) & (status <= 499)


def _exits(lock_ms: int, ttl_ms: int):
    """Per request of a segment: the run that would be the latest at the end, if this request executed."""

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "request_id"], ignore_index=True)
        last = last_executing(next_executing(*_arrays(pdf), lock_ms, ttl_ms))
        out = pdf[["__key", SEGMENT, "start", "request_id"]].copy()
        for name in ("request_id", "start", "end", "status", "response"):
            out[f"exit_{name}"] = pdf[name].to_numpy()[last]
        return out

    return exits


def _segment_outcomes(lock_ms: int, ttl_ms: int):
    """Outcomes of a segment's requests, given the run that was the latest when the segment began."""

    def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "request_id"], ignore_index=True)
        entry = pdf.iloc[0]
        if pd.notna(entry["entry_start"]):
            # The run before the segment takes part as its first row.
            first = {
                **{name: entry[f"entry_{name}"] for name in ("request_id", "start", "end", "status", "response")},
                "__key": entry["__key"],
                SEGMENT: entry[SEGMENT],
            }
            rows = pd.concat([pd.DataFrame([first]), pdf], ignore_index=True)
        else:
            rows = pdf
        at, end, finished, cached = _arrays(rows)
        nxt = next_executing(at, end, finished, cached, lock_ms, ttl_ms)
        executes = np.zeros(len(rows), dtype=bool)
        i = 0
        while i < len(rows):
            executes[i] = True
            i = nxt[i]
        # Governing run of each row: the latest executing row at or before it.
        source = np.maximum.accumulate(np.where(executes, np.arange(len(rows)), 0))
        running = ~finished[source] | (at < end[source])
        outcome = np.where(executes, EXECUTE, np.where(running, CONFLICT, REPLAY))
        replayed = outcome == REPLAY
        out = pd.DataFrame(
            {
                "outcome": outcome,
                "source_request_id": rows["request_id"].to_numpy()[source].astype("int64"),
                "replay_status": pd.Series(rows["status"].to_numpy()[source]).where(replayed).astype("Int32"),
                "replay_response": pd.Series(rows["response"].to_numpy()[source], dtype=object).where(replayed, None),
            }
        )
        out = out.iloc[len(rows) - len(pdf):]
        out.insert(0, "__row", pdf["__row"].to_numpy())
        return out

    return outcomes


def decide_one(run: dict | None, at_ms: int, lock_ms: int, ttl_ms: int) -> str:
    """``decide`` for a single request, outside a plan."""
    if run is None:
        return EXECUTE
    end, status = run["end"], run["status"]
    if end is None or at_ms < end:
        return CONFLICT if at_ms - run["start"] < lock_ms else EXECUTE
    return REPLAY if status is not None and 200 <= status <= 499 and at_ms - end < ttl_ms else EXECUTE


def _blocks_all(run: dict, first_ms: int, last_ms: int, lock_ms: int, ttl_ms: int) -> bool:
    """True when no request between the two times can execute after ``run``."""
    end = run["end"]
    lock_end = run["start"] + lock_ms
    if end is None or last_ms < end:
        return last_ms < lock_end
    cached = run["status"] is not None and 200 <= run["status"] <= 499
    return cached and last_ms < end + ttl_ms and (end <= lock_end or first_ms >= end)


def _run_at_exit(row: Row | None) -> dict | None:
    return None if row is None else {f.name: row[f"exit_{f.name}"] for f in RUN}


def _entry_runs(exits: DataFrame, lock_ms: int, ttl_ms: int, earlier: DataFrame | None = None) -> Iterator[dict]:
    """The latest run at the beginning of each segment of a key, walking a key's segments in order.

    The driver holds one row per segment, never requests. Most borders need no look at the data: a segment
    that the latest run blocks as a whole is passed over, and if its first request can execute, its row names
    the run it ends with. Else the first request that can execute is looked up in that one segment.
    """
    ending, order = F.struct(*[f"exit_{f.name}" for f in RUN]), F.struct("start", "request_id")
    spans = exits.groupBy("__key", SEGMENT).agg(
        F.min("start").alias("first_ms"), F.max("start").alias("last_ms"), F.min_by(ending, order).alias("first_exit")
    )
    spans = spans.withColumn("__earlier", F.lit(None).cast(RUN)) if earlier is None else spans.join(earlier, "__key", "left")
    key, run = None, None
    for span in sorted(spans.collect(), key=lambda row: (row["__key"], row[SEGMENT])):
        if span["__key"] != key:
            key, run = span["__key"], span["__earlier"] and span["__earlier"].asDict()
        if run is not None:
            yield {"__key": key, SEGMENT: span[SEGMENT], **{f"entry_{k}": v for k, v in run.items()}}
            if _blocks_all(run, span["first_ms"], span["last_ms"], lock_ms, ttl_ms):
                continue
        if decide_one(run, span["first_ms"], lock_ms, ttl_ms) == EXECUTE:
            run = _run_at_exit(span["first_exit"])
            continue
        latest = F.struct(*[F.lit(run[f.name]).cast(f.dataType).alias(f.name) for f in RUN])
        found = (
            exits.where((F.col(SEGMENT) == span[SEGMENT]) & (F.col("__key") == key))
            .where(decide(latest, F.col("start"), lock_ms, ttl_ms) == EXECUTE)
            .agg(F.min_by(ending, order).alias("found"))
            .first()["found"]
        )
        run = _run_at_exit(found) or run


def _large_keys(
    df: DataFrame, rows: int, segment_rows: int, lock_ms: int, ttl_ms: int, earlier: DataFrame | None = None
) -> DataFrame:
    """Outcomes ``(__row, ...)`` of keys too large for one array; ``__row`` names a row of ``df``.

    The requests are cut into consecutive segments. Each segment computes, for every request, which run it
    would end with if that request were its first to execute. With these answers the run at each segment
    border follows from border to border, and all segments then decide their requests in parallel.
    """
    spark = df.sparkSession
    narrow = df.select("__row", "__key", "__run.*")
    segments = max(1, math.ceil(rows / segment_rows))
    cut = range_segments(narrow, ["__key"], ["start", "request_id"], segments).drop("__tie")
    exit_type = T.StructType(
        [
            *[cut.schema[c] for c in ("__key", SEGMENT, "start", "request_id")],
            *[T.StructField(f"exit_{f.name}", f.dataType) for f in RUN],
        ]
    )
    # Only keys that reach over a border, or have an earlier run, need the answers.
    borders = cut.groupBy("__key").agg(F.countDistinct(SEGMENT).alias("n"))
    if earlier is None:
        borders = borders.where("n > 1").select("__key")
    else:
        borders = borders.join(earlier, "__key", "left").where("n > 1 or __earlier is not null").select("__key")
    exits = written_table(
        cut.join(borders, "__key", "left_semi")
        .groupBy("__key", SEGMENT)
        .applyInPandas(_exits(lock_ms, ttl_ms), exit_type),
        "segment-exits",
        partition_by=SEGMENT,
    )
    entry_type = T.StructType(
        [
            T.StructField("__key", T.StringType()),
            T.StructField(SEGMENT, T.IntegerType()),
            *[T.StructField(f"entry_{f.name}", f.dataType) for f in RUN],
        ]
    )
    entries = spark.createDataFrame(list(_entry_runs(exits, lock_ms, ttl_ms, earlier)), entry_type)
    result_type = T.StructType(
        [
            T.StructField("__row", T.LongType()),
            T.StructField("outcome", T.StringType()),
            T.StructField("source_request_id", T.LongType()),
            T.StructField("replay_status", T.IntegerType()),
            T.StructField("replay_response", T.StringType()),
        ]
    )
    # At most one entry per segment.
    return (
        cut.join(F.broadcast(entries), ["__key", SEGMENT], "left")
        .groupBy("__key", SEGMENT)
        .applyInPandas(_segment_outcomes(lock_ms, ttl_ms), result_type)
    )


# --- entry -------------------------------------------------------------------------------------------------


def large_keys(requests: DataFrame, max_key_rows: int = MAX_KEY_ROWS) -> LargeGroups:
    """Keys with more than ``max_key_rows`` requests; reads the key column only.

    Pass only requests whose key can count: a text such as "undefined", sent by many, is no key to fold.
    """
    keys = requests.select(F.col("idempotency_key").alias("__key")).where(F.col("__key").isNotNull())
    return large_groups(keys, ["__key"], max_key_rows)


def _run(status_col: str, response_col: str | None) -> Column:
    start = F.col("received_at_ms")
    response = F.col(response_col) if response_col else F.lit(None)
    return F.struct(
        F.col("request_id").cast("long").alias("request_id"),
        start.cast("long").alias("start"),
        (start + F.col("duration_ms")).cast("long").alias("end"),
        F.col(status_col).cast("int").alias("status"),
        response.cast("string").alias("response"),
    )


def latest_runs(
    decided: DataFrame,
    lock_s: int = LOCK_SECONDS,
    ttl_s: int = RESPONSE_TTL_SECONDS,
    *,
    status_col: str = "handler_status",
    response_col: str | None = None,
    earlier: DataFrame | None = None,
    alive_at_ms: int | None = None,
) -> DataFrame:
    """(idempotency_key, request_id, start, end, status, response): the latest executing run of each key.

    ``decided`` is the result of ``idempotency_outcomes``. A key without a new run keeps its ``earlier`` one. With
    ``alive_at_ms``, runs that decide no request from that time on are left out, so the table holds about ``ttl_s``
    seconds of runs. Write it, and give it to the next call as ``earlier``.
    """
    ran = (
        decided.where(F.col("outcome") == EXECUTE)
        .groupBy("idempotency_key")
        .agg(F.max_by(_run(status_col, response_col), F.struct("received_at_ms", "request_id")).alias("run"))
        .select("idempotency_key", "run.*")
    )
    runs = ran if earlier is None else earlier.join(ran, "idempotency_key", "left_anti").unionByName(ran)
    if alive_at_ms is None:
        return runs
    replays_until = F.when(F.col("status").between(200, 499), F.col("end") + ttl_s * 1000)
    return runs.where(F.greatest(F.col("start") + lock_s * 1000, replays_until) > alive_at_ms)


def idempotency_outcomes(
    requests: DataFrame,
    lock_s: int = LOCK_SECONDS,
    ttl_s: int = RESPONSE_TTL_SECONDS,
    *,
    status_col: str = "handler_status",
    response_col: str | None = None,
    eligible: Column | None = None,
    earlier: DataFrame | None = None,
    large: LargeGroups | None = None,
    max_key_rows: int = MAX_KEY_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add ``outcome``, ``source_request_id``, ``replay_status`` and ``replay_response``.

    ``status_col`` (and ``response_col``) hold what the request would answer if it executed; a null
    ``duration_ms`` is an unfinished request. Rows that are not ``eligible`` pass with a null outcome and
    touch no state. If two runs overlap after a lock expired, the newer one counts. ``request_id`` orders requests of
    one time; a record that the log holds twice is two requests.

    ``earlier`` are the runs before these requests, one row per key as ``latest_runs`` gives them. They come first, so
    logs taken one after the other give what one log gives.
    """
    lock_ms, ttl_ms = lock_s * 1000, ttl_s * 1000
    allowed = F.col("idempotency_key").isNotNull()
    if eligible is not None:
        allowed = allowed & F.coalesce(eligible, F.lit(False))
    prepared = requests.withColumns(
        {"__run": _run(status_col, response_col), "__eligible": allowed, "__key": F.when(allowed, F.col("idempotency_key"))}
    )
    if large is None:
        large = large_keys(requests.where(allowed), max_key_rows)
    if earlier is not None:
        earlier = earlier.select(F.col("idempotency_key").alias("__key"), F.struct(*RUN.fieldNames()).cast(RUN).alias("__earlier"))
    if not large.rows:
        return _fold_small_keys(prepared, lock_ms, ttl_ms, earlier)
    small = prepared.join(large.keys, "__key", "left_anti")
    # Written once: the rows are numbered, and several steps read them.
    big = written_table(
        prepared.join(large.keys, "__key", "left_semi").withColumn("__row", F.monotonically_increasing_id()), "large-keys"
    )
    outcomes = _large_keys(big, large.rows, segment_rows, lock_ms, ttl_ms, earlier)
    columns = [c for c in prepared.columns if not c.startswith("__")]
    joined = big.select(*columns, "__row").join(outcomes, "__row", "left").select(*columns, *RESULT_COLUMNS)
    return _fold_small_keys(small, lock_ms, ttl_ms, earlier).unionByName(joined)
