"""Expressions and steps that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of text that a Python worker holds at once, besides one row that is longer.
TEXTS_AT_ONCE = 4_000_000


def row_key(*columns: Column) -> Column:
    """A 128-bit hex digest of a row. Equal rows share it, null differs from every value."""
    flagged = [part for c in columns for part in (c.isNull().cast("string"), c.cast("string"))]
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(part, F.lit("")) for part in flagged]))


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as make it differ from all ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def fields_of(df: DataFrame) -> str:
    """The schema of ``df`` as text, for rows that keep it."""
    return ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in df.dtypes)


def blocks_of(batches: Iterable[pa.RecordBatch], text: str = "text", at_once: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none holds many more text bytes than ``at_once``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > at_once:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


#: A row's number in a written table, for ``numbered``.
ROW_NUMBER = "_row_number"


def with_row_number(df: DataFrame) -> DataFrame:
    """``df`` with a number that tells its rows apart, even exact copies; write it before use, so that it stays."""
    return df.withColumn(ROW_NUMBER, F.monotonically_increasing_id())


def numbered(df: DataFrame, keys: list[str], order_by: list[str], name: str, buckets: int = 256) -> DataFrame:
    """Add gapless numbers from 0 within ``keys``, and drop the row number.

    Rows of a key are dealt over ``buckets`` by a hash of their row number, numbered there in ``order_by`` and
    shifted by the counts of the buckets before, so neither a key with a third of all rows nor exact copies are one task. ``df`` is
    evaluated twice: pass a written table of ``with_row_number``. Keys must not be null.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(ROW_NUMBER), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = (
        dealt.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(before) - F.col("_rows"))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order_by, ROW_NUMBER)
    return (
        dealt.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("long"))
        .drop("_bucket", "_before", "_inside", ROW_NUMBER)
    )
