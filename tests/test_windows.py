"""Sliding statistics against a plain loop, and what each kind of message contributes."""

import random

import pytest
from gaugeflow.operators.parse import parse_events, with_event_time
from gaugeflow.operators.window_stats import type_stats, window_stats
from gaugeflow.schemas import WINDOW_EVENT
from pyspark.sql import functions as F
from telemetry import D, MINUTE, T, U, message

LAYOUT = "id string, eventType string, value double, timestamp long"
UNITS = {"minute": MINUTE, "second": 1_000}


def brute(rows, size, slide):
    groups = {}
    for rid, kind, value, at in rows:
        if at is None:
            continue
        start = at - at % slide
        while start > at - size:
            groups.setdefault((start, start + size, kind), []).append((rid, value))
            start -= slide
    out = {}
    for key, members in groups.items():
        values = [v for _, v in members if v is not None]
        ids = sum(rid is not None for rid, _ in members)
        out[key] = (sum(values) / len(values), min(values), max(values), ids) if values else (None, None, None, ids)
    return out


@pytest.mark.parametrize(
    "size,slide,size_ms,slide_ms",
    [
        ("5 minutes", "1 minute", 300_000, 60_000),
        ("1 minute", "1 minute", 60_000, 60_000),
        ("5 minutes", "2 minutes", 300_000, 120_000),
        ("90 seconds", "60 seconds", 90_000, 60_000),
    ],
)
def test_batch_windows(spark, size, slide, size_ms, slide_ms):
    rng = random.Random(11)
    rows = [
        (rng.choice([U(i), None]), rng.choice(["a", "b", None]), rng.choice([1.0, 2.5, 8.0, None]),
         rng.choice([T + rng.randrange(1_200_000), T + 60_000, -1 - rng.randrange(200_000), None]))
        for i in range(300)
    ]
    out = window_stats(spark.createDataFrame(rows, LAYOUT), size, slide)
    got = {
        (r.s, r.e, r.eventType): (r.avg_value, r.min_value, r.max_value, r.event_count)
        for r in out.withColumns({"s": F.unix_millis("window_start"), "e": F.unix_millis("window_end")}).collect()
    }
    expected = brute(rows, size_ms, slide_ms)
    assert got.keys() == expected.keys()
    for key, (mean, low, high, n) in expected.items():
        assert got[key][1:] == (low, high, n)
        assert got[key][0] == (None if mean is None else pytest.approx(mean, rel=1e-12))


def test_windows_must_not_leave_gaps(spark):
    with pytest.raises(ValueError):
        window_stats(spark.createDataFrame([], LAYOUT), "1 minute", "2 minutes")


def test_batch_equals_the_built_in_window(spark):
    rng = random.Random(2)
    rows = [(U(i), rng.choice("ab"), float(rng.randrange(64)), T + rng.randrange(3_600_000)) for i in range(500)]
    events = spark.createDataFrame(rows, LAYOUT)
    built_in = (
        with_event_time(events)
        .groupBy(F.window("event_time", "5 minutes", "1 minute"), "eventType")
        .agg(F.avg("value"), F.min("value"), F.max("value"), F.count("id"))
        .select("window.start", "window.end", "eventType", "avg(value)", "min(value)", "max(value)", "count(id)")
    )
    assert sorted(map(tuple, built_in.collect())) == sorted(map(tuple, window_stats(events).collect()))


def test_messages_in_the_aggregation(spark):
    texts = [
        message(value=1.0),
        message(value=3.0),  # redelivered: counted again
        "not json", "", None, "null", "[]",
        message(value="24.5"),  # counted, not averaged
        message(drop=("value",)),
        message(drop=("id",), value=5.0),  # averaged, not counted
        message(drop=("timestamp",)),
        message(timestamp=T + 0.5),
        message(eventType="x" * 51),
        message(drop=("eventType",)),
        message(deviceId="nope", value=7.0),
    ]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    rows = {r.eventType: tuple(r)[3:] for r in window_stats(parse_events(raw, WINDOW_EVENT)).collect()}
    assert rows == {
        "temperature": (4.0, 1.0, 7.0, 5),
        "x" * 51: (24.5, 24.5, 24.5, 1),
        None: (24.5, 24.5, 24.5, 1),
    }
    assert window_stats(parse_events(raw)).count() == 15
    # type_stats has no time: the two messages without a usable timestamp count, as do the all-null rows' groups.
    stats = {r.eventType: r.event_count for r in type_stats(parse_events(raw)).collect()}
    assert stats == {"temperature": 7, "x" * 51: 1, None: 1}


def test_parsed_fields(spark):
    raw = spark.createDataFrame([(bytearray(message(metadata={"n": 1.5, "b": True}).encode()),)], "value binary")
    row = parse_events(raw).first()
    assert (row.id, row.deviceId, row.value, row.timestamp) == (U(1), D(1), 24.5, T)
    assert row.metadata == {"n": "1.5", "b": "true"}


def test_only_needed_columns_are_read(spark, tmp_path):
    rows = [(U(1), D(1), "a", 1.0, T, None)]
    path = str(tmp_path / "events")
    from gaugeflow.schemas import RAW_EVENT

    spark.createDataFrame(rows, RAW_EVENT).write.parquet(path)
    plan = window_stats(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp," in plan
    assert "deviceId" not in plan and "metadata" not in plan
