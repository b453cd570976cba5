"""Cards, running means, log lines and the trailing chart."""

import random

import pytest
from gaugeflow.operators import live
from pyspark.sql import functions as F
from telemetry import D, T, U

LAYOUT = "id string, deviceId string, eventType string, value double, timestamp long"


def frame(spark, rows):
    return spark.createDataFrame([(U(i), D(1), k, v, t) for i, (k, v, t) in enumerate(rows)], LAYOUT)


def test_cards(spark):
    rows = [("temperature", 20.0, T), ("temperature", 20.5, T), ("cpu_usage", 40.0, T), ("other", 1.0, T)]
    assert tuple(live.live_totals(frame(spark, rows)).first()) == (4, "20.3", "40.0")
    assert tuple(live.live_totals(frame(spark, rows[3:])).first()) == (1, None, None)


def test_log_lines(spark):
    row = live.live_log_lines(frame(spark, [("temperature", 24.55, T)])).first()
    assert row.page_line == "00000000 > Type: temperature | Value: 24.6"
    assert row.cli_line == "Device: 00000000... | Type: temperature | Value: 24.55"


@pytest.mark.parametrize("max_group_rows", [1_000, 10])
def test_running_mean(spark, max_group_rows):
    rng = random.Random(4)
    rows = [(rng.choice(["temperature", "cpu_usage", "x"]), float(rng.randrange(50)), T + rng.randrange(40)) for _ in range(120)]
    sums, expected = {}, {}
    for i, (kind, value, _) in sorted(enumerate(rows), key=lambda r: (r[1][2], r[0])):
        if kind != "x":
            total, n = sums.get(kind, (0.0, 0))
            sums[kind] = (total + value, n + 1)
            expected[U(i)] = (total + value) / (n + 1)
    out = live.running_type_avg(frame(spark, rows), max_group_rows=max_group_rows)
    assert {r.id: r.running_avg for r in out.collect()} == expected


def test_running_mean_over_days_and_runs(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["temperature", "cpu_usage"]), rng.choice([None, float(rng.randrange(50))]), T + rng.randrange(6 * 86_400_000)) for _ in range(200)]
    rows += [("temperature", 5.0, None)]
    events = frame(spark, rows)
    whole = {r.id: r.running_avg for r in live.running_type_avg(events).collect()}
    sums, expected = {}, {}
    for i, (kind, value, _) in sorted(enumerate(rows), key=lambda r: (r[1][2] or 0, r[0])):
        total, n = sums.get(kind, (0.0, 0))
        sums[kind] = total, n = (total + (value or 0.0), n + (value is not None))
        expected[U(i)] = total / n if n else None
    assert whole == expected
    cut, seen, before = [T + k * 86_400_000 for k in (1, 3, 4, 9)], {}, None
    for lo, hi in zip([0, *cut], cut):
        part = events.where(F.coalesce("timestamp", F.lit(0)).between(lo, hi - 1))
        seen |= {r.id: r.running_avg for r in live.running_type_avg(part, before=before).collect()}
        before = spark.createDataFrame(live.type_totals(part, before=before).collect(), "eventType string, total double, events long")
    assert seen == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trailing_chart(spark, seed):
    rng = random.Random(seed)
    # The first series is rare, so that gaps at the left edge are filled from before the chart.
    rows = [("temperature" if rng.random() < 0.05 else rng.choice("ab"), float(i), T + rng.randrange(200_000)) for i in range(150)]
    seconds = {}
    for i, (kind, value, at) in sorted(enumerate(rows), key=lambda r: (r[1][2], r[0])):
        seconds.setdefault(at - at % 1000, {})[1 if kind == "temperature" else 2] = value
    last, points = {1: None, 2: None}, []
    for second in sorted(seconds):
        last.update(seconds[second])
        points.append((second, last[1], last[2]))
    out = live.trailing_chart(frame(spark, rows)).collect()
    assert sorted((r.second_ms, r.series_1, r.series_2) for r in out) == points[-25:]
    plan = live.trailing_chart(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
    assert out[0].label == "12:0" + f"{(out[0].second_ms - T) // 60_000}:{(out[0].second_ms - T) // 1_000 % 60:02d}"
