"""Counters of the storage pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.storage_rules import with_stored_columns


def batch_counters(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """The counters of a batch of topic ``messages`` against the ``stored(id)``, from one read and parse of the batch.

    Messages are reduced to their ids, map side; an id that is not stored yet is inserted once, however often it comes.
    """
    checked = with_stored_columns(messages)
    good = F.col("reason").isNull()
    ids = checked.groupBy(F.when(good, F.col("event.id")).alias("id")).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    known = stored.select("id", F.lit(True).alias("known")).where(F.col("id").isNotNull())
    is_new = F.col("id").isNotNull() & F.col("known").isNull()
    return ids.join(known, "id", "left").agg(
        F.coalesce(F.sum("good"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("failed"),
        F.count_if(is_new).alias("inserted"),
        (F.coalesce(F.sum("good"), F.lit(0)) - F.count_if(is_new)).alias("duplicates"),
    )


COUNTERS = ("processed", "failed", "inserted")


def pipeline_counters(valid: DataFrame, bad: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: messages processed (duplicates included), failed, inserted, and duplicates skipped."""
    counts = [
        df.agg(*[(F.count(F.lit(1)) if name == own else F.lit(0).cast("long")).alias(name) for name in COUNTERS])
        for own, df in zip(COUNTERS, (valid, bad, inserted), strict=True)
    ]
    return (
        counts[0].unionByName(counts[1]).unionByName(counts[2])
        .agg(*[F.sum(name).alias(name) for name in COUNTERS])
        .withColumn("duplicates", F.col("processed") - F.col("inserted"))
    )
