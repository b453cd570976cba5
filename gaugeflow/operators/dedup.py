"""First-write-wins deduplication and insert-if-absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A batch of ids up to this many is shipped to the scan of the stored ids (under 100 bytes each).
BROADCAST_IDS = 500_000


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in ``order``.

    Spark keeps one row per key and map task before the shuffle (group limit of a rank filter), so a key with
    very many copies sends at most one row per task.
    """
    ranked = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranked)).where("__rank = 1").drop("__rank")


def new_only(
    batch: DataFrame, stored: DataFrame, key: str = "id", batch_rows: int | None = None
) -> DataFrame:
    """Rows of a deduplicated ``batch`` whose key is not stored yet.

    With a known small ``batch_rows`` the batch keys are broadcast to the scan of the stored keys, which then
    needs no shuffle; only keys that are already there come back. Otherwise both sides shuffle on the key.
    """
    stored_keys = stored.select(key)
    if batch_rows is not None and batch_rows <= BROADCAST_IDS:
        stored_keys = stored_keys.join(F.broadcast(batch.select(key)), key, "left_semi")
    return batch.join(stored_keys, key, "left_anti")
