"""Admission over several micro-batches: equal to the table, replay-safe, with the simulator's scenarios."""

import json
import random

import pytest
from gaugeflow.operators.admission import admit, publish_payload, to_topic_records
from gaugeflow.schemas import DISPOSITION, REQUEST_LOG
from gaugeflow.sources.readers import read_requests
from gaugeflow.streaming.admission import admitted, fed, published, read_limited, run_admission, run_limiter
from telemetry import D, MINUTE, T, U, body, clients, request

ONCE = {"availableNow": True}
DAY = 86_400_000


def run_parts(spark, folder, parts, **options):
    """Each part is one micro-batch of a gateway that restarts for it."""
    for rows in parts:
        spark.createDataFrame(rows, REQUEST_LOG).write.mode("append").parquet(f"{folder}/log")
        stream = read_requests(spark, f"{folder}/log", streaming=True)
        query = run_admission(stream, clients(spark), f"{folder}/out", f"{folder}/checkpoint", ONCE, **options)
        query.awaitTermination()
    return f"{folder}/out"


def rows_of(df):
    return sorted(map(str, df.select(*DISPOSITION.fieldNames()).collect()))


def random_log(seed):
    rng = random.Random(seed)
    times = sorted(T + rng.choice([rng.randrange(60_000), rng.randrange(3 * DAY)]) for _ in range(60))
    return [
        request(
            i,
            received_at_ms=at,
            idempotency_key=rng.choice([U(1), U(2), U(3), "bad", None]),
            body=rng.choice([body(timestamp=at), body(timestamp=at), body(value="x"), "{"]),
            api_key=rng.choice(["good"] * 6 + ["old", None]),
            duration_ms=rng.choice([None, 5, 100, 40_000, DAY]),
            handler_status=rng.choice([202, 202, 500]),
        )
        for i, at in enumerate(times)
    ]


@pytest.mark.parametrize("seed", [1])
def test_micro_batches_equal_the_table(spark, tmp_path, seed):
    rows = random_log(seed)
    out = run_parts(spark, tmp_path, [rows[:15], rows[15:35], rows[35:]])
    table = admit(spark.createDataFrame(rows, REQUEST_LOG), clients(spark))
    assert rows_of(admitted(spark, out)) == rows_of(table)
    topic = to_topic_records(publish_payload(table))
    assert sorted(map(tuple, published(spark, out).collect())) == sorted(map(tuple, topic.collect()))
    ids = [json.loads(r.value)["id"] for r in fed(spark, out).collect()]
    assert sorted(ids) == sorted(json.loads(r.value)["id"] for r in topic.collect())


def test_scenarios_over_batches(spark, tmp_path):
    sent = [(300 * i, ["temperature", "cpu_usage"][i % 2]) for i in range(20)]
    later = [request(100 + i, received_at_ms=T + s, body=body(deviceId=D(i % 2), timestamp=T + s, eventType=t)) for i, (s, t) in enumerate(sent)]
    parts = [
        [request(1, api_key="bad"), request(2, body=body(timestamp=T - 10 * MINUTE)), request(3), *later[:7]],
        [request(4, idempotency_key=U(3), received_at_ms=T + 50), *later[7:]],
        [request(5, idempotency_key=U(3), received_at_ms=T + 200), request(6, idempotency_key=U(2), received_at_ms=T + 5_000)],
    ]
    out = run_parts(spark, tmp_path, parts)
    got = {r.request_id: r for r in admitted(spark, out).collect()}
    assert [got[i].status_code for i in range(1, 7)] == [401, 400, 202, 409, 202, 400]
    assert got[5].reason == got[6].reason == "replayed" and [e.field for e in got[6].errors] == ["timestamp"]
    assert published(spark, out).count() == 21


def test_a_replayed_batch_decides_as_before(spark, tmp_path):
    """The broker fails once, after the second batch has written its answers; the restarted gateway takes that batch again."""
    parts = [[request(1)], [request(2, idempotency_key=U(1), received_at_ms=T + 1_000), request(3)]]
    sent = []

    def publish(records, number):
        sent.append((number, records.count()))
        if [n for _, n in sent if n] == [1, 1]:
            raise ConnectionError("no broker")

    run_parts(spark, tmp_path, parts[:1], publish=publish)
    with pytest.raises(Exception, match="no broker"):
        run_parts(spark, tmp_path, parts[1:], publish=publish)
    out = run_parts(spark, tmp_path, [[]], publish=publish)
    assert {r.request_id: r.reason for r in admitted(spark, out).collect()} == {1: "accepted", 2: "replayed", 3: "accepted"}
    assert admitted(spark, out).count() == 3 and published(spark, out).count() == 0
    first, failed, again = [x for x in sent if x[1]]
    assert failed == again != first


def test_a_batch_touches_its_own_keys_only(spark, tmp_path):
    """What a batch reads and writes of the state does not grow with the keys before it."""
    for part in range(4):
        rows = [request(1000 * part + i, idempotency_key=U(1000 * part + i), received_at_ms=T + 1000 * part) for i in range(100 if part < 3 else 5)]
        spark.createDataFrame(rows, REQUEST_LOG).write.mode("append").parquet(f"{tmp_path}/log")
        stream = read_requests(spark, f"{tmp_path}/log", streaming=True)
        query = run_admission(stream, clients(spark), f"{tmp_path}/out", f"{tmp_path}/checkpoint", ONCE)
        query.awaitTermination()
    first = next(p for p in query.recentProgress if p.numInputRows)
    assert first.numInputRows == 5
    state = first.stateOperators[0]
    assert state.numRowsUpdated == 5 and state.numRowsTotal == 305
    assert state.customMetrics["rocksdbGetCount"] < 50 and state.customMetrics["rocksdbPutCount"] < 50
    assert admitted(spark, f"{tmp_path}/out").count() == 305


@pytest.mark.parametrize("seed", [4])
def test_rate_limit_over_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    times = sorted(T + rng.randrange(200_000) for _ in range(150))
    rows = [
        request(i, received_at_ms=at, idempotency_key=U(rng.randrange(100)), body=body(timestamp=at), api_key=rng.choice(["good", "good", "old", None]), duration_ms=rng.choice([5, 900]))
        for i, at in enumerate(times)
    ]
    folder = str(tmp_path)
    for part in (rows[:40], rows[40:100], rows[100:]):
        spark.createDataFrame(part, REQUEST_LOG).write.mode("append").parquet(f"{folder}/log")
        requests = read_requests(spark, f"{folder}/log", streaming=True)
        run_limiter(requests, clients(spark), f"{folder}/limited", f"{folder}/c1", ONCE, 60, 20).awaitTermination()
        run_admission(read_limited(spark, f"{folder}/limited"), clients(spark), f"{folder}/out", f"{folder}/c2", ONCE).awaitTermination()
    table = admit(spark.createDataFrame(rows, REQUEST_LOG), clients(spark), rate_limit=(60, 20))
    assert rows_of(admitted(spark, f"{folder}/out")) == rows_of(table)
    assert table.where("status_code = 429").count() > 10


def test_a_short_run_does_not_revive_the_one_it_replaced(spark, tmp_path):
    # The first run holds its lock for less time than it takes; the second executes, fails and is over soon.
    parts = [
        [request(1, duration_ms=DAY)],
        [request(2, idempotency_key=U(1), received_at_ms=T + DAY // 2, body=body(timestamp=T + DAY // 2), handler_status=500)],
        [request(3, idempotency_key=U(1), received_at_ms=T + DAY + 1, body=body(timestamp=T + DAY + 1))],
    ]
    out = run_parts(spark, tmp_path, parts)
    assert {r.request_id: r.reason for r in admitted(spark, out).collect()}[3] == "accepted"


def test_no_requests(spark, tmp_path):
    out = run_parts(spark, tmp_path, [[]])
    assert admitted(spark, out).count() == published(spark, out).count() == fed(spark, out).count() == 0
