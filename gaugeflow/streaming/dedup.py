"""Delivery deduplication on a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.eventtime import has_event_time
from gaugeflow.operators.parse import with_event_time


def dedup_stream(df: DataFrame, key: str = "id", horizon: str = "24 hours", ms_col: str = "timestamp") -> DataFrame:
    """The first delivery of each key within ``horizon``, with its ``event_time``.

    Rows without key or time are left out: they would all be kept as duplicates of nothing.

    State holds the keys of the last ``horizon`` only. For an unbounded horizon the stored table itself is
    asked (``storage.store_events``).
    """
    known = df.where(F.col(key).isNotNull() & has_event_time(F.col(ms_col)))
    return (
        with_event_time(known, ms_col).withWatermark("event_time", horizon).dropDuplicatesWithinWatermark([key])
    )


def _first_rows(key: str, order: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            places = [(key, "ascending"), *((name, "ascending") for name in order)]
            at = pa.compute.sort_indices(rows.select([key, *order]), sort_keys=places, null_placement="at_start")
            keys = rows.column(key).take(at).combine_chunks()
            new = np.ones(len(keys), bool)
            new[1:] = pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            held = rows.take(at.filter(pa.array(new))).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return first_rows


def first_deliveries(
    df: DataFrame, key: str = "id", order: Sequence[str] = ("partition", "offset"), horizon: str = "24 hours", ms_col: str = "timestamp"
) -> DataFrame:
    """The first delivery of each key within ``horizon``, always the same one, with all columns and ``event_time``.

    The deliveries of a micro-batch are dealt by key, and of each key the first in ``order`` stays, nulls first; keyed state
    then drops what an earlier micro-batch has delivered, whatever its order. Topic offsets grow with arrival, so a stream that is
    cut into other micro-batches keeps the same rows. A task holds one row per key of its part of the micro-batch. The state
    are the keys of the last ``horizon`` of event time. Rows without key or time are left out.
    """
    known = with_event_time(df.where(F.col(key).isNotNull() & has_event_time(F.col(ms_col))), ms_col)
    firsts = known.repartition(key).mapInArrow(_first_rows(key, order), known.schema)
    return firsts.withWatermark("event_time", horizon).dropDuplicatesWithinWatermark([key])
