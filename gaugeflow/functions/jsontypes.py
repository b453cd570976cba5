"""JSON documents as variants: what a field *is*, not what it can be cast to."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strict JSON: no single quotes, no NaN.
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters do not evaluate again.

    A filter on a projected column is pushed below the projection with the expression copied into it, once per
    use. It is not pushed below a generator, so the projected value passes through one: an explode of a single
    element.
    """
    projected = df.select("*", value.alias("__value"))
    return projected.select("*", F.expr(f"explode_outer(array(__value)) AS {name}")).drop("__value")


def json_documents(text: Column, fields: Sequence[str]) -> Column:
    """Array of the top-level objects in ``text``, each declared field a variant; null when malformed.

    The text is parsed inside brackets: a plain parse stops after the first document and would accept
    whatever follows it.
    """
    layout = ", ".join(f"{name}: variant" for name in fields)
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{layout}>>", STRICT_JSON)


def _kind_sql(tag: str) -> str:
    """JSON kind for a ``schema_of_variant`` text (null for an absent field)."""
    return f"""CASE WHEN {tag} IS NULL THEN 'undefined' WHEN {tag} = 'STRING' THEN 'string'
        WHEN {tag} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({tag}, 'DECIMAL') THEN 'number'
        WHEN {tag} = 'BOOLEAN' THEN 'boolean' WHEN {tag} = 'VOID' THEN 'null'
        WHEN startswith({tag}, 'OBJECT<') THEN 'object' ELSE 'array' END"""


def json_kind(value: Column) -> Column:
    """``undefined``, ``null``, ``boolean``, ``number``, ``string``, ``array`` or ``object``."""
    tag = F.schema_of_variant(value)
    return (
        F.when(tag.isNull(), "undefined")
        .when(tag == "STRING", "string")
        .when(tag.isin("BIGINT", "DOUBLE", "FLOAT") | tag.startswith("DECIMAL"), "number")
        .when(tag == "BOOLEAN", "boolean")
        .when(tag == "VOID", "null")
        .when(tag.startswith("OBJECT<"), "object")
        .otherwise("array")
    )


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


class JsonField(NamedTuple):
    """A JSON field: its kind, and its text and number if it has one."""

    kind: Column
    text: Column
    number: Column

    @staticmethod
    def of(value: Column) -> JsonField:
        kind = json_kind(value)
        return JsonField(kind, as_text(value), F.when(kind == "number", as_number(value)))

    def is_finite_number(self) -> Column:
        """A JSON number that a double holds as a finite value."""
        return F.coalesce(
            (self.kind == "number") & (F.abs(self.number) < F.lit(float("inf"))), F.lit(False)
        )

    def is_whole_number(self) -> Column:
        return self.is_finite_number() & F.coalesce(self.number == F.floor(self.number), F.lit(False))


def with_fields(df: DataFrame, doc: str, fields: Sequence[str], name: str) -> DataFrame:
    """Add struct ``name``: kind, text and number of each field of the document column ``doc``.

    In steps, so that each later one reads a finished column: type tags, kinds, then the values by kind.
    """
    tags = ", ".join(f"schema_of_variant({doc}.{f}) AS {f}" for f in fields)
    kinds = ", ".join(f"{_kind_sql(f'__tags.{f}')} AS {f}" for f in fields)
    values = ", ".join(
        f"""struct(__kinds.{f} AS kind,
            CASE WHEN __kinds.{f} IN ('object', 'array') THEN to_json({doc}.{f})
                 ELSE try_variant_get({doc}.{f}, '$', 'string') END AS text,
            CASE WHEN __kinds.{f} = 'number' THEN try_variant_get({doc}.{f}, '$', 'double') END AS number) AS {f}"""
        for f in fields
    )
    tagged = computed_once(df, "__tags", F.expr(f"struct({tags})"))
    with_kinds = computed_once(tagged, "__kinds", F.expr(f"struct({kinds})"))
    return computed_once(with_kinds, name, F.expr(f"struct({values})")).drop("__tags", "__kinds")


def read_field(values: Column, name: str) -> JsonField:
    """The field from a struct that ``with_fields`` added."""
    return JsonField(values[name]["kind"], values[name]["text"], values[name]["number"])
