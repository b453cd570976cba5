"""Rows that pass through keyed state in Python unchanged.

A row travels as one JSON text: every further column would be converted for each key by itself, and pandas turns nullable
integers into floating point, which holds no id above 2^53.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__row"
_EXACT = {f"timestamp{kind}Format": f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}" for kind, zone in (("", "XXX"), ("NTZ", ""))}


def travelling(columns: Sequence[str]) -> Column:
    """The row as it travels."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", **_EXACT}).alias(ROW)


def arrived(columns: Sequence[str]) -> list[Column]:
    """``columns`` of a frame that ``unpacked`` made."""
    return [F.col(f"{ROW}.{c}").alias(c) for c in columns]


def unpacked(found: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``found`` with its ``__row`` read as ``columns`` of ``df``; read once however many columns there are."""
    layout = T.StructType([df.schema[c] for c in columns])
    return found.withColumn(ROW, F.from_json(ROW, layout, _EXACT))
