"""What is stored, what is dead-lettered, and replays."""

import os

import pytest
from gaugeflow.operators.counters import batch_counters, pipeline_counters
from gaugeflow.operators.dedup import dedup_first, new_only
from gaugeflow.operators.lookup import device_type_lookup, latest
from gaugeflow.operators.storage_rules import split_dlq, stored_events
from gaugeflow.schemas import STORED_EVENT
from gaugeflow.sources.readers import read_events
from gaugeflow.streaming import membership
from gaugeflow.streaming.storage import store_batch
from pyspark.sql import functions as F
from telemetry import D, T, U, message

STORED = [
    message(),
    message(value="24.5"),
    message(eventType="x"),
    message(eventType=""),
    message(timestamp=1),
    message(timestamp=-5),
    message(timestamp=str(T)),
    message(raw={"timestamp": f"{T}.0"}),
    message(eventType=7),
    message(id=U(1).upper()),
    message(deviceId="c3f00573-0f9c-0ebc-0e79-ffca90123abc"),
    message(metadata=[1], extra={}),
    '{"value":"first",' + message()[1:],
]
DEAD = {
    "empty message": [None, ""],
    "not a JSON object": ["not json", "null", "[]", "5", message() + message(), message()[:-1]],
    "id is not a UUID": [message(drop=("id",)), message(id=7), message(id="nope")],
    "device_id is not a UUID": [message(deviceId="77a793fa-d630-4e3a-9644-88fa90123xyz"), message(drop=("deviceId",))],
    "event_type is null": [message(drop=("eventType",)), message(eventType=None)],
    "event_type is too long": [message(eventType="x" * 51)],
    "value is not a double": [message(drop=("value",)), message(value=None), message(value=True), message(value="x"),
                              message(value="1e400"), message(value=[1])],
    "timestamp is not a bigint": [message(drop=("timestamp",)), message(timestamp=T + 0.5), message(timestamp="1.5"),
                                  message(raw={"timestamp": "1e19"})],
}


def test_split(spark):
    dead = [(text, reason) for reason, texts in DEAD.items() for text in texts]
    texts = STORED + [t for t, _ in dead]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, value string")
    good, bad = split_dlq(df)
    assert {r.key for r in good.select("key").collect()} == {f"k{i}" for i in range(len(STORED))}
    expected = {(f"k{i + len(STORED)}", t, r) for i, (t, r) in enumerate(dead)}
    assert {tuple(r) for r in bad.collect()} == expected
    stored = {r.key: r for r in stored_events(good, "key").collect()}
    assert tuple(stored["k0"])[:5] == (U(1), D(1), "temperature", 24.5, T)
    assert stored["k1"].value == 24.5 and stored["k6"].timestamp == T and stored["k7"].timestamp == T
    assert stored["k8"].event_type == "7" and stored["k9"].id == U(1) and stored["k12"].value == 24.5


def test_special_doubles(spark):
    texts = {'"NaN"': "NaN", '"-Infinity"': "-Infinity", '" 1.5e3 "': "1500.0", "1e400": "Infinity"}
    for raw, text in texts.items():
        df = spark.createDataFrame([("k", message(raw={"value": raw}))], "key string, value string")
        assert stored_events(split_dlq(df)[0]).select(F.col("value").cast("string")).first()[0] == text, raw


def test_parsing_is_not_repeated_by_the_split(spark):
    df = spark.createDataFrame([("k", message())], "key string, value string")
    for part in split_dlq(df):
        assert part._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 9, "only")], "id string, offset int, v string")
    assert {(r.id, r.v) for r in dedup_first(df, "id", ["offset"]).collect()} == {("a", "first"), ("b", "only")}
    plan = dedup_first(df, "id", ["offset"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("batch_rows", [None, 3, 10_000_000])
def test_new_only(spark, batch_rows):
    batch = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    stored = spark.createDataFrame([("b",), ("z",)], "id string")
    assert {r.id for r in new_only(batch, stored, batch_rows=batch_rows).collect()} == {"a", "c"}


def batch(spark, *texts):
    rows = [(f"k{i}", t, 0, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "key string, value string, partition int, offset long")


def contents(spark, path):
    return {(r.id, r.value) for r in read_events(spark, path).collect()}


def test_batches_and_replays(spark, tmp_path):
    path, dlq = str(tmp_path / "events"), str(tmp_path / "dlq")
    first = batch(spark, message(value=1), message(value=2), message(id=U(2), value=3), "bad", None)
    store_batch(first, 0, path, dlq)
    assert contents(spark, path) == {(U(1), 1.0), (U(2), 3.0)}
    second = batch(spark, message(id=U(2), value=9), message(id=U(3), value=4), "worse")
    for _ in range(2):  # the second run is a replay after a failure
        store_batch(second, 1, path, dlq)
        assert contents(spark, path) == {(U(1), 1.0), (U(2), 3.0), (U(3), 4.0)}
        assert {r.value for r in spark.read.parquet(dlq).collect()} == {"bad", None, "worse"}
    store_batch(first, 2, path, dlq, horizon="1 day")  # the same messages under a new batch id
    assert contents(spark, path) == {(U(1), 1.0), (U(2), 3.0), (U(3), 4.0)}
    assert read_events(spark, path).where(F.col("created_at").isNull()).count() == 0


def test_counters(spark):
    good, bad = split_dlq(batch(spark, message(value=1), message(value=2), message(id=U(2)), "bad"))
    new = new_only(dedup_first(stored_events(good, "offset"), "id", ["offset"]), spark.createDataFrame([(U(2),)], "id string"))
    assert tuple(pipeline_counters(good, bad, new).first()) == (3, 1, 1, 2)
    messages, stored = batch(spark, message(value=1), message(value=2), message(id=U(2)), "bad"), spark.createDataFrame([(U(2),), (None,)], "id string")
    one = batch_counters(messages, stored)
    assert one.columns == ["processed", "failed", "inserted", "duplicates"] and tuple(one.first()) == (3, 1, 1, 2)
    assert tuple(batch_counters(messages.where("false"), stored).first()) == (0, 0, 0, 0)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_lookups(spark, tmp_path):
    path = str(tmp_path / "events")
    texts = [message(id=U(i), deviceId=D(i % 3), eventType="ab"[i % 2], timestamp=T + i) for i in range(12)]
    store_batch(batch(spark, *texts), 0, path, str(tmp_path / "dlq"))
    events = read_events(spark, path)
    assert [r.id for r in latest(events, 3).collect()] == [U(11), U(10), U(9)]
    found = device_type_lookup(events, D(1), "b", T + 1, T + 7)
    assert [r.id for r in found.collect()] == [U(1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(device_id,{D(1)})" in plan and "EqualTo(event_type,b)" in plan
    assert "TakeOrderedAndProject" in latest(events, 3)._jdf.queryExecution().executedPlan().toString()


def ids(spark, *numbers):
    return spark.createDataFrame([(U(n),) for n in numbers], "id string")


def test_index_opens_only_files_that_may_hold_an_id(spark, tmp_path):
    folder = str(tmp_path / "ids")
    assert membership.files_to_open(ids(spark, 1), 0, folder) == []
    for batch_id in range(4):
        membership.remember(ids(spark, *range(1000 * batch_id, 1000 * batch_id + 700)), batch_id, folder)
    files = [f for _, _, names in os.walk(folder + "/files") for f in names if f.endswith(".parquet")]
    assert len(files) == 4 * membership.BUCKETS
    # New ids open nothing, a stored one the file it is in, and a batch does not see itself.
    assert membership.files_to_open(ids(spark, *range(50_000, 52_000)), 9, folder) == []
    one = membership.files_to_open(ids(spark, 2005, 60_000), 9, folder)
    assert len(one) == 1 and "/batch_id=2/" in one[0]
    assert membership.files_to_open(ids(spark, 2005), 2, folder) == []
    asked = ids(spark, 5, 699, 700, 1005, 3699, 3700, 60_000)
    found = membership.stored_ids(asked, 9, folder)
    assert sorted(r.id for r in found.collect()) == [U(5), U(699), U(1005), U(3699)]
    assert len(found.inputFiles()) == len(membership.files_to_open(asked, 9, folder)) <= 4
    # Null and empty.
    assert membership.stored_ids(spark.createDataFrame([(None,)], "id string"), 9, folder).count() == 0
    membership.remember(ids(spark).where("false"), 7, folder)
    assert membership.stored_ids(asked, 9, folder).count() == 4


def test_compacted_index(spark, tmp_path):
    folder = str(tmp_path / "ids")
    for batch_id in range(5):
        membership.remember(ids(spark, *range(100 * batch_id, 100 * batch_id + 100)), batch_id, folder)
    membership.compact(spark, folder, 4)
    asked = ids(spark, *range(0, 700, 7))
    assert sorted(r.id for r in membership.stored_ids(asked, 9, folder).collect()) == [U(n) for n in range(0, 500, 7)]
    assert {f.split("/batch_id=")[1].split("/")[0] for f in membership.files_to_open(asked, 9, folder)} == {"3", "4"}
    # The latest batch is replayed with fewer ids.
    membership.remember(ids(spark, 401), 4, folder)
    assert sorted(r.id for r in membership.stored_ids(ids(spark, 1, 400, 401), 9, folder).collect()) == [U(1), U(401)]


def test_a_range_of_time_opens_its_dates_only(spark, tmp_path):
    path, day = str(tmp_path / "events"), 86_400_000
    texts = [message(id=U(i), deviceId=D(i % 3), timestamp=T + i * day) for i in range(8)] + [message(id=U(99), timestamp=2**62)]
    store_batch(batch(spark, *texts), 0, path, str(tmp_path / "dlq"))
    assert read_events(spark, path).count() == 9 and read_events(spark, path).columns == STORED_EVENT.fieldNames()
    found = read_events(spark, path, T + 2 * day, T + 4 * day + 1)
    assert sorted(r.id for r in found.collect()) == [U(2), U(3), U(4)]
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(event_date" in scan and "PushedFilters" in scan
    read = found.select("id").inputFiles()
    assert len(read) == 9  # the files of the table; those of other dates are pruned when it runs
    metrics = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    found._jdf.queryExecution().executedPlan().executeCollect()
    assert metrics.apply("numPartitions").value() == 3 and metrics.apply("numFiles").value() == 3
