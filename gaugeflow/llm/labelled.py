"""Training rows for the text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on at most; the bound of everything that reaches the driver.
TRAINING_ROWS = 12_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels no model sees; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAINING_ROWS, *also: str) -> DataFrame:
    """(doc_id, text, y, also...) of at most ``rows`` labelled documents outside the held-out fold, drawn by a hash of the id.

    A document with several labels counts as 1 if any is; one with several texts gives the smallest, with its columns ``also``.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long"), "text", *also)
    # Bounded by `rows` pairs of numbers.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"), *[F.min_by(c, "text").alias(c) for c in also])
