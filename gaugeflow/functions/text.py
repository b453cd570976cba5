"""String and number formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: RFC 9562 layout with version 1-8 and variant 8-b, or the nil or max UUID.
UUID_PATTERN = (
    r"^([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"
    r"|00000000-0000-0000-0000-000000000000|ffffffff-ffff-ffff-ffff-ffffffffffff)\z"
)
UUID_V4_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\z"

# A uuid-typed table column takes any hex digits, hyphens after any group of four, and braces.
STORED_UUID_PATTERN = r"^(\{[0-9a-fA-F]{4}(-?[0-9a-fA-F]{4}){7}\}|[0-9a-fA-F]{4}(-?[0-9a-fA-F]{4}){7})\z"


def is_uuid(value: Column, strict_v4: bool = False) -> Column:
    """True for an RFC 9562 UUID text, false otherwise (also for null)."""
    return F.coalesce(value.rlike(UUID_V4_PATTERN if strict_v4 else UUID_PATTERN), F.lit(False))


def is_storable_uuid(value: Column) -> Column:
    """True for text that a uuid-typed column accepts, false otherwise (also for null)."""
    return F.coalesce(value.rlike(STORED_UUID_PATTERN), F.lit(False))


def canonical_uuid(value: Column) -> Column:
    """Lower-case 8-4-4-4-12 form, the identity a uuid-typed column compares by."""
    digits = F.regexp_replace(F.lower(value), "[{}-]", "")
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 code units, the unit in which the gateway measures strings."""
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def to_fixed(value: Column, digits: int) -> Column:
    """Fixed-decimal text of a double; exact ties round away from zero."""
    number = value.cast("double")
    # A double lies exactly between two results only as an odd multiple of 2^-(digits+1).
    is_tie = (F.abs(number) * 2.0 ** (digits + 1)) % 2 == 1
    nudged = F.when(is_tie, number * (1 + 2.0**-40)).otherwise(number)
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", nudged, F.lit(pattern))
