"""Fixture values: T is 2024-06-01T12:00:00Z, U(n) an event or idempotency id, D(n) a device id."""

from __future__ import annotations

import json

T = 1_717_243_200_000
MINUTE = 60_000


def U(n: int) -> str:
    return f"00000000-0000-4000-8000-{n:012d}"


def D(n: int) -> str:
    return f"00000000-0000-4000-8001-{n:012d}"


def body(drop: tuple = (), raw: dict | None = None, **fields) -> str:
    """A valid body with fields replaced, dropped, or written as raw JSON text."""
    doc = {"deviceId": D(1), "eventType": "temperature", "value": 24.5, "timestamp": T, **fields}
    parts = [f"{json.dumps(k)}:{json.dumps(v)}" for k, v in doc.items() if k not in drop and k not in (raw or {})]
    parts += [f"{json.dumps(k)}:{v}" for k, v in (raw or {}).items()]
    return "{" + ",".join(parts) + "}"


def message(drop: tuple = (), raw: dict | None = None, **fields) -> str:
    return body(drop, raw, **{"id": U(1), **fields})


def request(request_id: int, **columns) -> tuple:
    row = {
        "received_at_ms": T,
        "api_key": "good",
        "client_ip": "10.0.0.1",
        "idempotency_key": U(request_id),
        "method": "POST",
        "route": "/v1/events",
        "body": body(),
        "duration_ms": 100,
        "handler_status": 202,
        **columns,
    }
    names = ("received_at_ms", "api_key", "client_ip", "idempotency_key", "method", "route", "body", "duration_ms",
             "handler_status")
    return (request_id, *[row[n] for n in names])


def clients(spark):
    from gaugeflow.schemas import CLIENT

    return spark.createDataFrame(
        [("c1", "good", "Good", True, None), ("c2", "old", "Old", False, None), ("c3", "unset", "Unset", None, None)],
        CLIENT,
    )
