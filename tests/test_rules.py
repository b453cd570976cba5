"""Boundary tests of the gateway rules, each body otherwise valid."""

from gaugeflow.functions.jsontypes import JsonField
from gaugeflow.operators import rules as R
from gaugeflow.operators.rules import validate, validation_errors
from pyspark.sql import functions as F
from telemetry import D, T, body

DRIFT = "Timestamp must be within 5 minutes of server time (clock drift check)"
UUID = "deviceId must be a valid UUID v4"


def _wrong(kind, received):
    return f"Invalid input: expected {kind}, received {received}"


CASES = {
    # deviceId
    body(deviceId="c3f00573-0f9c-4ebc-be79-ffca90123abc"): [],
    body(deviceId="77a793fa-d630-4e3a-9644-88fa90123xyz"): [("deviceId", UUID)],
    body(deviceId=""): [("deviceId", UUID)],
    body(deviceId=7): [("deviceId", _wrong("string", "number"))],
    body(drop=("deviceId",)): [("deviceId", _wrong("string", "undefined"))],
    # eventType
    body(eventType="ab"): [],
    body(eventType="x" * 50): [],
    body(eventType="😀"): [],
    body(eventType="x"): [("eventType", "Too small: expected string to have >=2 characters")],
    body(eventType="x" * 51): [("eventType", "Too big: expected string to have <=50 characters")],
    body(eventType=5): [("eventType", _wrong("string", "number"))],
    body(drop=("eventType",)): [("eventType", _wrong("string", "undefined"))],
    # value
    body(value=0): [],
    body(value=-1.5): [],
    body(raw={"value": "1e3"}): [],
    body(value="24.5"): [("value", _wrong("number", "string"))],
    body(value=True): [("value", _wrong("number", "boolean"))],
    body(value=None): [("value", _wrong("number", "null"))],
    body(drop=("value",)): [("value", _wrong("number", "undefined"))],
    body(raw={"value": "1e400"}): [("value", _wrong("number", "Infinity"))],
    # timestamp
    body(timestamp=T - 300_000): [],
    body(timestamp=T + 300_000): [],
    body(raw={"timestamp": f"{T}.0"}): [],
    body(timestamp=T - 300_001): [("timestamp", DRIFT)],
    body(timestamp=T + 300_001): [("timestamp", DRIFT)],
    body(timestamp=T - 600_000): [("timestamp", DRIFT)],
    body(timestamp=0): [("timestamp", "Too small: expected number to be >0"), ("timestamp", DRIFT)],
    body(timestamp=-1): [("timestamp", "Too small: expected number to be >0"), ("timestamp", DRIFT)],
    body(timestamp=T + 0.5): [("timestamp", _wrong("int", "number"))],
    body(timestamp=str(T)): [("timestamp", _wrong("number", "string"))],
    # metadata
    body(metadata={}): [],
    body(metadata={"a": "s", "n": 1.5, "b": True}): [],
    body(metadata=None): [("metadata", _wrong("record", "null"))],
    body(metadata=[1]): [("metadata", _wrong("record", "array"))],
    body(metadata="s"): [("metadata", _wrong("record", "string"))],
    body(metadata={"o": {"k": 1}}): [("metadata.o", "Invalid input")],
    body(metadata={"a": None}): [("metadata.a", "Invalid input")],
    # documents
    body(extra=1): [],
    body(deviceId="x", value="y"): [("deviceId", UUID), ("value", _wrong("number", "string"))],
    '{"value":"first",' + body()[1:]: [],
    "": [(f, _wrong(k, "undefined")) for f, k in
         (("deviceId", "string"), ("eventType", "string"), ("value", "number"), ("timestamp", "number"))],
    "[]": [("", _wrong("object", "array"))],
    None: [("", _wrong("object", "undefined"))],
}

MALFORMED = ["{", "not json", "null", "5", '"s"', body() + " x", body() + "," + body(), body() + body(),
             "{'value':1}", '{"value":NaN}', '{"value":007}', "[1", "[1],[2]", " "]


def test_boundaries(spark):
    texts = list(CASES)
    df = spark.createDataFrame([(i, T, t) for i, t in enumerate(texts)], "request_id long, received_at_ms long, body string")
    rows = validate(df).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = CASES[texts[row.request_id]]
        assert [(e.field, e.message) for e in row.errors] == expected, texts[row.request_id]


def test_malformed_bodies(spark):
    df = spark.createDataFrame([(i, T, t) for i, t in enumerate(MALFORMED)], "request_id long, received_at_ms long, body string")
    rows = validate(df).collect()
    assert [(r.body_kind, r.errors) for r in rows] == [("malformed", None)] * len(MALFORMED), rows


def test_errors_as_rows(spark):
    df = spark.createDataFrame(
        [(1, T, body(deviceId="x", value="y")), (2, T, body())], "request_id long, received_at_ms long, body string"
    )
    assert {(r.request_id, r.field) for r in validation_errors(validate(df)).collect()} == {(1, "deviceId"), (1, "value")}


def test_json_is_parsed_once(spark):
    df = spark.createDataFrame([(1, T, body())], "request_id long, received_at_ms long, body string")
    plan = validate(df).where(F.size("errors") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_predicates_are_never_null(spark):
    texts = [None, "null", "{}", "[]", '"x"', f'"{D(1)}"', '"ab"', "1", "1.5", "-1", "1e400", "9007199254740993", f"{T}"]
    values = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.try_parse_json("t").alias("v"))
    field = JsonField.of(F.col("v"))
    rules = {
        "device": (R.is_device_id(field), {f'"{D(1)}"'}),
        "type": (R.is_event_type(field), {f'"{D(1)}"', '"ab"'}),
        "value": (R.is_value(field), {"1", "1.5", "-1", "9007199254740993", f"{T}"}),
        "integer": (R.is_integer(field), {"1", "-1", f"{T}"}),
        "timestamp": (R.is_timestamp(field), {"1", f"{T}"}),
        "drift": (R.is_within_drift(field, F.lit(T)), {f"{T}"}),
        "metadata": (R.is_metadata(F.col("v")), {None, "{}"}),
        "header": (R.is_present(F.col("t")), set(texts) - {None}),
        "small": (R.is_body_small_enough(F.col("t"), 4), {None, "null", "{}", "[]", '"x"', '"ab"', "1", "1.5", "-1"}),
        "route": (R.is_measured_route(F.col("t")), set(texts)),
    }
    out = values.select("t", *[rule.alias(name) for name, (rule, _) in rules.items()]).collect()
    for name, (_, accepted) in rules.items():
        assert {r[name] for r in out} <= {True, False}
        assert {r.t for r in out if r[name]} == accepted, name
