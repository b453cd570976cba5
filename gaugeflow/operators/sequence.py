"""Per-device order of a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.ordered import MAX_GROUP_ROWS, running_totals


def device_sequence(
    messages: DataFrame, key: str = "key", order: str = "offset", max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add ``seq_no``, the place of each message among its device's messages."""
    return running_totals(messages, [key], [order], {"seq_no": F.lit(1).cast("long")}, max_group_rows)


def by_device(messages: DataFrame, key: str = "key", order: str = "offset") -> DataFrame:
    """The physical form: all messages of a device in one partition, in order, as a topic holds them."""
    return messages.repartition(key).sortWithinPartitions(key, order)
