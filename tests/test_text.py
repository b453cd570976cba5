import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.eventtime import duration_ms, floor_to
from gaugeflow.functions.text import canonical_uuid, is_storable_uuid, is_uuid, to_fixed, utf16_length

UUIDS = {
    "c3f00573-0f9c-4ebc-be79-ffca90123abc": (True, True),
    "C3F00573-0F9C-4EBC-BE79-FFCA90123ABC": (True, True),
    "c3f00573-0f9c-1ebc-8e79-ffca90123abc": (True, False),
    "c3f00573-0f9c-0ebc-8e79-ffca90123abc": (False, False),
    "c3f00573-0f9c-4ebc-ce79-ffca90123abc": (False, False),
    "77a793fa-d630-4e3a-9644-88fa90123xyz": (False, False),
    "00000000-0000-0000-0000-000000000000": (True, False),
    "ffffffff-ffff-ffff-ffff-ffffffffffff": (True, False),
    "c3f00573-0f9c-4ebc-be79-ffca90123abc\n": (False, False),
    "": (False, False),
    None: (False, False),
}


def test_uuid(spark):
    df = spark.createDataFrame([(u,) for u in UUIDS], "u string")
    rows = df.select("u", is_uuid(F.col("u")), is_uuid(F.col("u"), strict_v4=True)).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == UUIDS


@pytest.mark.parametrize(
    "text,canonical",
    [
        ("C3F005730F9C0EBCBE79FFCA90123ABC", "c3f00573-0f9c-0ebc-be79-ffca90123abc"),
        ("{c3f00573-0f9c-4ebc-be79-ffca90123abc}", "c3f00573-0f9c-4ebc-be79-ffca90123abc"),
        ("c3f0-0573-0f9c-4ebc-be79-ffca-9012-3abc", "c3f00573-0f9c-4ebc-be79-ffca90123abc"),
        ("{c3f00573-0f9c-4ebc-be79-ffca90123abc", None),
        ("c3f0057-30f9c-4ebc-be79-ffca90123abc", None),
    ],
)
def test_storable_uuid(spark, text, canonical):
    row = spark.range(1).select(is_storable_uuid(F.lit(text)).alias("ok"), canonical_uuid(F.lit(text)).alias("c")).first()
    assert row.ok == (canonical is not None)
    assert not row.ok or row.c == canonical


def test_to_fixed(spark):
    cases = [(0.15, 1, "0.1"), (0.25, 1, "0.3"), (0.35, 1, "0.3"), (2.25, 1, "2.3"), (-0.25, 1, "-0.3"), (24.5, 1, "24.5"),
             (1.005, 2, "1.00"), (0.125, 2, "0.13"), (100.0, 2, "100.00"), (1234567.0, 1, "1234567.0"), (2.5, 0, "3")]
    for value, digits, text in cases:
        assert spark.range(1).select(to_fixed(F.lit(value), digits)).first()[0] == text, (value, digits)


def test_lengths_and_time(spark):
    row = spark.range(1).select(
        utf16_length(F.lit("aé😀")), floor_to(F.lit(-1), 60_000), floor_to(F.lit(60_000), 60_000)
    ).first()
    assert tuple(row) == (4, -60_000, 60_000)
    assert duration_ms("5 minutes") == 300_000 and duration_ms("1 hour") == 3_600_000
    with pytest.raises(ValueError):
        duration_ms("1 month")
