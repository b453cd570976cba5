"""Running totals, usage, requests in flight and sequences against plain loops, with groups cut and not cut."""

import random
from bisect import bisect_left

import pytest
from gaugeflow.operators.ordered import running_totals
from gaugeflow.operators.rate import rate_usage
from gaugeflow.operators.request_metrics import (
    active_requests,
    peak_requests,
    batch_duration_histogram,
    duration_histogram,
    request_counts,
)
from gaugeflow.operators.sequence import by_device, device_sequence
from gaugeflow.schemas import REQUEST_LOG
from pyspark.sql import functions as F
from telemetry import T, request

SIZES = [1_000_000, 40, 7]


@pytest.mark.parametrize("max_group_rows", SIZES)
def test_running_totals(spark, max_group_rows):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", None, "a", "b"]), rng.randrange(50), i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v long")
    out = running_totals(df, ["k"], ["t", "id"], {"total": F.col("v"), "n": F.lit(1).cast("long")}, max_group_rows)
    expected, sums = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        s, n = sums.get(k, (0, 0))
        sums[k] = expected[i] = (s + v, n + 1)
    assert {r.id: (r.total, r.n) for r in out.collect()} == expected
    assert out.columns == ["k", "t", "id", "v", "total", "n"]


def test_exact_copies_are_cut_too(spark):
    df = spark.range(0, 500, 1, 8).select(F.lit("k").alias("k"), F.lit(1).alias("t"), F.lit(2).cast("long").alias("v"))
    out = running_totals(df, ["k"], ["t"], {"total": F.col("v")}, max_group_rows=50)
    assert sorted(r.total for r in out.collect()) == list(range(2, 1_001, 2))


def test_sampled_search_for_large_groups(spark):
    n = 30_000
    df = spark.range(0, n, 1, 8).select((F.col("id") % 3 == 0).cast("string").alias("k"), "id")
    out = running_totals(df, ["k"], ["id"], {"n": F.lit(1).cast("long")}, max_group_rows=4_096)
    wrong = out.where(
        F.col("n") != F.when(F.col("k") == "true", F.floor(F.col("id") / 3) + 1).otherwise(
            F.col("id") - F.floor(F.col("id") / 3))
    )
    assert out.count() == n and wrong.count() == 0


@pytest.mark.parametrize("max_group_rows", SIZES)
def test_rate_usage(spark, max_group_rows):
    rng = random.Random(3)
    rows = [
        (i, T + rng.randrange(300) * 1_000, rng.choice(["c1", "c1", "c2", "", None]), rng.choice(["10.0.0.1", "", None]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "request_id long, received_at_ms long, client_id string, client_ip string")
    calls, expected = {}, {}
    for rid, at, client, ip in sorted(rows, key=lambda r: (r[1], r[0])):
        who = client or ip or "anonymous"
        calls.setdefault(who, []).append(at)
        used = len(calls[who]) - bisect_left(calls[who], at - 60_000)
        expected[rid] = (who, used, used > 20)
    out = rate_usage(df, 60, 20, max_group_rows)
    assert {r.request_id: (r.caller, r.used, r.limited) for r in out.collect()} == expected
    assert any(limited for *_, limited in expected.values())


@pytest.mark.parametrize("bucket_ms", [1, 7, 60_000])
def test_active_requests(spark, bucket_ms):
    rng = random.Random(5)
    rows = [
        request(i, received_at_ms=T + rng.randrange(500), duration_ms=rng.choice([None, 0, 3, 70]),
                route=rng.choice(["/v1/events", "/health", "/metrics", None]))
        for i in range(200)
    ]
    log = spark.createDataFrame(rows, REQUEST_LOG)
    change = {}
    for r in rows:
        at, route, duration = r[1], r[6], r[8]
        if route in ("/health", "/metrics"):
            continue
        change[at] = change.get(at, 0) + 1
        if duration is not None:
            change[at + duration] = change.get(at + duration, 0) - 1
    expected, running = {}, 0
    for at in sorted(change):
        running += change[at]
        expected[at] = running
    assert {r.at_ms: r.active_requests for r in active_requests(log, bucket_ms).collect()} == expected
    most = max(expected.values())
    assert [tuple(r) for r in peak_requests(log, bucket_ms).collect()] == [(min(at for at, n in expected.items() if n == most), most)]
    assert active_requests(log.where("false")).count() == peak_requests(log.where("false")).count() == 0
    plan = active_requests(log)._jdf.queryExecution().optimizedPlan().toString()
    # The window over raw instants is one per bucket; only span totals are ordered as a whole.
    assert plan.count("Window") == 3 and "windowspecdefinition(bucket" in plan


def test_request_metrics(spark):
    rows = [request(i, duration_ms=d) for i, d in enumerate([10, 11, 50, 5_000, 5_001, None])] + [request(9, route="/health")]
    log = spark.createDataFrame(rows, REQUEST_LOG).withColumn("status_code", F.col("handler_status"))
    assert [tuple(r) for r in request_counts(log).collect()] == [("POST", "/v1/events", 202, 5)]
    buckets = {r.le: r.bucket_count for r in duration_histogram(log).collect()}
    assert buckets == {"0.01": 1, "0.05": 3, "0.1": 3, "0.2": 3, "0.5": 3, "1": 3, "2": 3, "5": 4, "+Inf": 5}
    row = duration_histogram(log).first()
    assert (row.duration_count, row.duration_sum) == (5, 10.072)
    batches = spark.createDataFrame([(40,), (700,)], "duration_ms long")
    assert {r.le: r.bucket_count for r in batch_duration_histogram(batches).collect()}["0.05"] == 1


@pytest.mark.parametrize("max_group_rows", [1_000, 5])
def test_device_sequence(spark, max_group_rows):
    rows = [(f"d{i % 3 if i % 2 else 0}", i * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, offset long")
    out = device_sequence(df, max_group_rows=max_group_rows)
    seen, expected = {}, {}
    for key, offset in rows:
        seen[key] = expected[(key, offset)] = seen.get(key, 0) + 1
    assert {(r.key, r.offset): r.seq_no for r in out.collect()} == expected
    parts = by_device(df).withColumn("p", F.spark_partition_id())
    assert parts.groupBy("key").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
