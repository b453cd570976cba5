"""Idempotency sequences and a brute-force check of both ways to fold a key."""

import random

import pytest
from gaugeflow.operators.idempotency import idempotency_outcomes, latest_runs
from pyspark.sql import functions as F
from telemetry import T, U

LAYOUT = "request_id long, idempotency_key string, received_at_ms long, duration_ms long, handler_status int"
E, C, R = "EXECUTE", "CONFLICT", "REPLAY"

# (start after T, duration or None, status) -> outcome
SEQUENCES = [
    ([(0, 100, 202), (50, 100, 202)], [E, C]),
    ([(0, 100, 202), (100, 100, 202)], [E, R]),
    ([(0, 100, 400), (5_000, 100, 202)], [E, R]),
    ([(0, 100, 500), (200, 100, 202)], [E, E]),
    ([(0, None, 202), (9_999, None, 202), (10_000, None, 202)], [E, C, E]),
    ([(0, 100, 202), (100 + 86_399_999, 100, 202), (100 + 86_400_000, 100, 202)], [E, R, E]),
    ([(0, 0, 202), (80_000_000, 0, 202), (86_400_000, 0, 202), (90_000_000, 0, 202)], [E, R, E, R]),
    ([(0, 100, 202), (0, 100, 202), (0, 100, 202)], [E, C, C]),
    # A run longer than its lock: a second run may start, or the first one's answer is replayed.
    ([(0, 30_000, 202), (10_000, 100, 202), (10_050, 100, 202), (10_200, 1, 202)], [E, E, C, R]),
    ([(0, 30_000, 202), (30_000, 100, 202)], [E, R]),
    ([(0, 30_000, 500), (30_000, 100, 202)], [E, E]),
]


def brute(rows, lock_ms=10_000, ttl_ms=86_400_000):
    """{request_id: (outcome, source, replayed status)} by a plain loop."""
    out, runs = {}, {}
    for rid, key, at, duration, status in sorted(rows, key=lambda r: (r[2], r[0])):
        run = runs.get(key)
        outcome = E
        if run:
            end = None if run[3] is None else run[2] + run[3]
            if end is None or at < end:
                outcome = C if at - run[2] < lock_ms else E
            elif 200 <= run[4] < 500 and at - end < ttl_ms:
                outcome = R
        if outcome == E:
            runs[key] = run = (rid, key, at, duration, status)
        out[rid] = (outcome, run[0], run[4] if outcome == R else None)
    return out


def result(df):
    return {r.request_id: (r.outcome, r.source_request_id, r.replay_status) for r in df.collect()}


@pytest.mark.parametrize("max_key_rows", [100, 1])
def test_a_record_that_the_log_holds_twice(spark, max_key_rows):
    rows = [(1, U(1), T, 100, 202), (2, U(1), T + 50, 100, 202), (2, U(1), T + 50, 100, 202), (3, U(1), T + 200, 100, 202)]
    rows += [(1, U(2), T, 100, 202)] * 2
    out = idempotency_outcomes(spark.createDataFrame(rows, LAYOUT), max_key_rows=max_key_rows)
    got = sorted((r.idempotency_key, r.request_id, r.outcome) for r in out.collect())
    assert got == [(U(1), 1, E), (U(1), 2, C), (U(1), 2, C), (U(1), 3, R), (U(2), 1, C), (U(2), 1, E)]


@pytest.mark.parametrize("max_key_rows", [100, 1])
def test_sequences(spark, max_key_rows):
    rows, expected, rid = [], {}, 0
    for key, (requests, outcomes) in enumerate(SEQUENCES):
        for (start, duration, status), outcome in zip(requests, outcomes):
            rid += 1
            rows.append((rid, U(key), T + start, duration, status))
            expected[rid] = outcome
    df = spark.createDataFrame(rows, LAYOUT)
    actual = result(idempotency_outcomes(df, max_key_rows=max_key_rows, segment_rows=3))
    assert {k: v[0] for k, v in actual.items()} == expected
    assert actual == brute(rows)


def random_requests(seed, n, keys, span_ms):
    rng = random.Random(seed)
    rows = []
    for rid in range(n):
        # A third of all requests share the first key.
        key = 0 if rng.random() < 0.34 else rng.randrange(keys)
        duration = rng.choice([None, 0, 1, 50, 500, 9_999, 10_000, 15_000, 40_000])
        rows.append((rid, U(key), T + rng.randrange(span_ms), duration, rng.choice([202, 202, 400, 500, 500, 503])))
    return rows


@pytest.mark.parametrize(
    "seed,span_ms,max_key_rows,segment_rows",
    [
        (1, 3 * 86_400_000, 5_000, 1_000),  # one array per key
        (2, 3 * 86_400_000, 20, 60),  # every key cut, long spans
        (3, 120_000, 20, 60),  # dense: runs overlap and cross the borders
        (4, 2_000, 20, 60),  # many requests in one millisecond
        (5, 3 * 86_400_000, 200, 5_000),  # large keys, one segment
    ],
)
def test_random_requests(spark, seed, span_ms, max_key_rows, segment_rows):
    rows = random_requests(seed, 1_500, 8, span_ms)
    df = spark.createDataFrame(rows, LAYOUT).withColumn("note", F.concat(F.lit("r"), "request_id"))
    decided = idempotency_outcomes(
        df, response_col="note", max_key_rows=max_key_rows, segment_rows=segment_rows
    )
    out = decided.collect()
    assert len(out) == len(rows)
    assert result(decided) == brute(rows)
    for r in out:
        assert r.note == f"r{r.request_id}"
        assert r.replay_response == (f"r{r.source_request_id}" if r.outcome == R else None)


def test_rows_that_do_not_take_part(spark):
    rows = [(1, None, T, 100, 202), (2, U(1), T, 100, 202), (3, U(1), T + 10, 100, 202), (4, U(1), T + 20, 100, 202)]
    df = spark.createDataFrame(rows, LAYOUT)
    for max_key_rows in (100, 1):
        actual = result(idempotency_outcomes(df, eligible=F.col("request_id") != 2, max_key_rows=max_key_rows))
        assert actual == {1: (None, None, None), 2: (None, None, None), 3: (E, 3, None), 4: (C, 3, None)}


@pytest.mark.parametrize("max_key_rows,segment_rows", [(5_000, 1_000), (20, 60), (20, 5_000)])
@pytest.mark.parametrize("span_ms", [3 * 86_400_000, 120_000])
def test_two_logs_in_sequence_equal_one(spark, span_ms, max_key_rows, segment_rows):
    rows = random_requests(31, 800, 8, span_ms)
    log = spark.createDataFrame(rows, LAYOUT).withColumn("note", F.concat(F.lit("r"), "request_id"))
    cut, found, runs = T + span_ms // 2, [], None
    for part in (log.where(F.col("received_at_ms") < cut), log.where(F.col("received_at_ms") >= cut)):
        decided = idempotency_outcomes(
            part, response_col="note", earlier=runs, max_key_rows=max_key_rows, segment_rows=segment_rows
        )
        found += decided.collect()
        runs = latest_runs(decided, response_col="note", earlier=runs, alive_at_ms=cut)
    assert {r.request_id: (r.outcome, r.source_request_id, r.replay_status) for r in found} == brute(rows)
    assert len(found) == len(rows)
    assert all(r.replay_response == (f"r{r.source_request_id}" if r.outcome == R else None) for r in found)


@pytest.mark.parametrize("max_key_rows", [100, 1])
def test_requests_before_the_earlier_run(spark, max_key_rows):
    first = idempotency_outcomes(spark.createDataFrame([(1, U(1), T, 100, 202)], LAYOUT))
    late = [(2, U(1), T - 50, 10, 202), (3, U(1), T - 20, 10, 202), (4, U(1), T + 200, 10, 202), (5, U(1), T + 86_400_100, 10, 202)]
    out = idempotency_outcomes(spark.createDataFrame(late, LAYOUT), earlier=latest_runs(first), max_key_rows=max_key_rows)
    assert result(out) == {2: (C, 1, None), 3: (C, 1, None), 4: (R, 1, 202), 5: (E, 5, None)}


def test_rows_without_id_and_key_are_groups_of_their_own(spark):
    layout = "request_id long, idempotency_key string, received_at_ms long, duration_ms long, handler_status int"
    rows = [(None, None, T, 5, 202)] * 300 + [(1, U(1), T, 5, 202), (None, U(1), T + 50, 5, 202)]
    out = idempotency_outcomes(spark.createDataFrame(rows, layout))
    assert out.count() == 302 and out.where("outcome is null").count() == 300
    assert sorted(r.outcome for r in out.where("outcome is not null").collect()) == ["EXECUTE", "REPLAY"]
    grouped = out._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" in grouped
