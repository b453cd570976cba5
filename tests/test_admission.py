"""Admission order, simulator scenarios A-D, publishing."""

import json

import pytest
from gaugeflow.operators import admission as adm
from gaugeflow.operators.clients import attach_client, upsert_clients_if_absent
from gaugeflow.schemas import CLIENT, DISPOSITION, REQUEST_LOG
from gaugeflow.sources.readers import read_clients
from gaugeflow.sources.writers import write_dispositions
from pyspark.sql import functions as F
from telemetry import D, MINUTE, T, U, body, clients, request


def admit(spark, rows, **options):
    log = spark.createDataFrame(rows, REQUEST_LOG)
    return adm.admit(log, clients(spark), **options)


def answers(df):
    return {r.request_id: (r.status_code, r.reason) for r in df.collect()}


def test_first_failing_rule_wins(spark):
    bad = body(value="x")
    pad = len(body(pad="").encode())
    rows = {
        1: (dict(body=body(pad="x" * (10_240 - pad))), (202, "accepted")),
        2: (dict(body=body(pad="x" * (10_241 - pad)), api_key=None), (413, "payload_too_large")),
        3: (dict(body="{", api_key=None), (400, "malformed_json")),
        4: (dict(api_key=None, body=bad), (401, "missing_api_key")),
        5: (dict(api_key="", body=bad), (401, "missing_api_key")),
        6: (dict(api_key="nobody", body=bad), (401, "invalid_api_key")),
        7: (dict(api_key="old", idempotency_key=None), (401, "deactivated_api_key")),
        8: (dict(api_key="unset"), (401, "deactivated_api_key")),
        9: (dict(idempotency_key=None, body=bad), (400, "missing_idempotency_key")),
        10: (dict(idempotency_key="", body=bad), (400, "missing_idempotency_key")),
        11: (dict(idempotency_key="not-a-uuid", body=bad), (400, "invalid_idempotency_key")),
        12: (dict(body=bad), (400, "validation_failed")),
        13: (dict(handler_status=500), (500, "handler_failed")),
        14: (dict(duration_ms=None), (None, "unfinished")),
        15: (dict(body=None), (400, "validation_failed")),
        16: (dict(handler_status=None), (202, "accepted")),
    }
    out = admit(spark, [request(i, **columns) for i, (columns, _) in rows.items()])
    assert answers(out) == {i: expected for i, (_, expected) in rows.items()}
    assert out.columns == DISPOSITION.fieldNames()


@pytest.mark.parametrize("max_key_rows", [100, 1])
def test_corrected_body_gets_the_old_answer(spark, max_key_rows):
    rows = [
        request(1, body=body(value="x")),
        request(2, idempotency_key=U(1), received_at_ms=T + 5_000),
        request(3, idempotency_key=U(1), received_at_ms=T + 5_000, api_key="nobody"),
        request(4, idempotency_key=U(1), received_at_ms=T + 100 + 86_400_000, body=body(timestamp=T + 86_400_000)),
    ]
    out = {r.request_id: r for r in admit(spark, rows, max_key_rows=max_key_rows, segment_rows=1).collect()}
    assert [out[i].status_code for i in (1, 2, 3, 4)] == [400, 400, 401, 202]
    assert out[2].reason == "replayed" and out[2].source_request_id == 1
    assert [e.field for e in out[2].errors] == ["value"]
    assert out[4].errors == [] and out[3].errors is None


def test_simulator_scenarios(spark):
    scenario_d = [
        request(100 + i, received_at_ms=T + 300 * i, body=body(deviceId=D(i % 2), timestamp=T + 300 * i, eventType=t))
        for i, t in enumerate(["temperature", "cpu_usage"] * 10)
    ]
    rows = [
        request(1, api_key="bad"),  # A
        request(2, body=body(timestamp=T - 10 * MINUTE)),  # B
        *[request(i, idempotency_key=U(3)) for i in (3, 4, 5)],  # C
        *scenario_d,
    ]
    out = admit(spark, rows)
    got = answers(out)
    assert got[1] == (401, "invalid_api_key") and got[2] == (400, "validation_failed")
    assert [got[i][0] for i in (3, 4, 5)] == [202, 409, 409]
    assert {r.outcome: r.requests for r in adm.disposition_tally(out).collect()} == {"202": 21, "400": 1, "401": 1, "409": 2}


def test_rate_limit_counts_requests_that_reach_it(spark):
    rows = [request(i, received_at_ms=T + i) for i in range(1, 6)]
    rows.append(request(10, received_at_ms=T + 3, api_key="bad"))
    # At T+60003 the calls 3, 4 and 5 still count (both ends included, refused calls too); at T+60005 5 and 11 do.
    rows += [request(i, received_at_ms=t, body=body(timestamp=t)) for i, t in ((11, T + 60_003), (12, T + 60_005))]
    expected = {1: 202, 2: 202, 3: 202, 4: 429, 5: 429, 10: 401, 11: 429, 12: 202}
    for max_group_rows in (1_000, 2):
        got = answers(admit(spark, rows, rate_limit=(60, 3), max_group_rows=max_group_rows))
        assert {i: status for i, (status, _) in got.items()} == expected


def test_publish(spark):
    metadata = {"n": 1.5, "s": "x", "b": True}
    rows = [
        request(1, body=body(metadata=metadata, extra="dropped")),
        request(2, body=body(raw={"timestamp": f"{T}.0", "value": "1e3"})),
        request(3, idempotency_key=U(1), received_at_ms=T + 1_000),  # replay: nothing published
        request(4, body=body(value="x")),
    ]
    payload = adm.publish_payload(admit(spark, rows))
    records = {r.key + json.loads(r.value)["id"]: json.loads(r.value) for r in adm.to_topic_records(payload).collect()}
    base = {"deviceId": D(1), "eventType": "temperature", "timestamp": T}
    assert records == {
        D(1) + U(1): {"id": U(1), **base, "value": 24.5, "metadata": metadata},
        D(1) + U(2): {"id": U(2), **base, "value": 1000.0},
    }
    assert {tuple(r) for r in adm.ack_records(payload).collect()} == {(U(1), D(1), T), (U(2), D(1), T)}


def test_carried_columns_and_the_written_log(spark, tmp_path):
    rows = [request(1), request(2, idempotency_key=U(1), received_at_ms=T + 1_000), request(3, body=body(value="x"))]
    full = admit(spark, rows)
    narrow = admit(spark, rows, carry=["request_id"])
    assert narrow.columns == ["request_id", *DISPOSITION.fieldNames()[10:]]
    assert answers(narrow) == answers(full)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("collect_list"):].split("\n")[0]
    assert "body" not in exchange
    path = str(tmp_path / "dispositions")
    for _ in range(2):
        write_dispositions(full, path)
    assert spark.read.schema(DISPOSITION).parquet(path).count() == 6


def test_clients_beyond_the_broadcast_limit(spark):
    log = spark.createDataFrame([request(i, api_key=k) for i, k in enumerate(["good"] * 6 + ["old", "nobody", None])], REQUEST_LOG)
    expected = sorted((r.request_id, r.client_id or "") for r in attach_client(log, clients(spark)).collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_client(log, clients(spark))
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.request_id, r.client_id or "") for r in joined.collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_client_lookup_never_multiplies(spark):
    double = clients(spark).unionByName(spark.createDataFrame([("c9", "good", "Copy", False, None)], CLIENT))
    log = spark.createDataFrame([request(1), request(2, api_key="nobody"), request(3, api_key=None)], REQUEST_LOG)
    rows = {r.request_id: r.client_id for r in attach_client(log, double).collect()}
    assert rows == {1: "c1", 2: None, 3: None}


def test_read_clients(spark, tmp_path):
    path = str(tmp_path / "clients")
    clients(spark).write.parquet(path)
    assert read_clients(spark, path).where("active").count() == 1


def test_clients_insert_if_absent(spark):
    new = spark.createDataFrame(
        [("n1", "good", "Again", True, None), ("n2", "fresh", "A", True, None), ("n3", "fresh", "B", True, None)], CLIENT
    )
    rows = {r.api_key: r.id for r in upsert_clients_if_absent(new, clients(spark)).collect()}
    assert rows == {"good": "c1", "old": "c2", "unset": "c3", "fresh": "n2"}
    assert upsert_clients_if_absent(new, clients(spark)).where(F.col("api_key") == "fresh").count() == 1


def test_defaults_of_a_seeded_client(spark):
    seeded = upsert_clients_if_absent(
        spark.createDataFrame([("new", "B"), ("new", "A"), ("good", "Taken")], "api_key string, name string"), clients(spark)
    )
    rows = {r.api_key: r for r in seeded.collect()}
    assert sorted(rows) == ["good", "new", "old", "unset"] and rows["good"].name == "Good" and rows["unset"].active is None
    assert rows["new"].name == "A" and rows["new"].active and len(rows["new"].id) == 36 and rows["new"].created_at is not None
