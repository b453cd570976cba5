"""Compare the rows of each bucket, however large the bucket, without pairs in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gaugeflow.materialize import written_table

#: kernel(rows, starts, side): rows of whole buckets, where each bucket starts (and the end), and for a cut
#: bucket the side of each row; rows of side 0 are then compared with those of side 1 only.
Kernel = Callable[[pa.Table, np.ndarray, "np.ndarray | None"], pa.RecordBatch]
ROWS_AT_ONCE = 65_536


def _starts(rows: pa.Table, by: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for name in by:
        values = rows.column(name).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _whole_buckets(batches: Iterator[pa.RecordBatch], by: list[str], most: int | None) -> Iterator[tuple]:
    """(rows, starts, None) of whole buckets, or (None, key, size) of a bucket with more than ``most`` rows."""
    held: pa.Table | None = None
    skipping, skipped = None, 0
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        rows = rows if held is None else pa.concat_tables([held, rows])
        held = None
        starts = _starts(rows, by)
        if skipping is not None:
            first = tuple(rows.column(name)[0].as_py() for name in by)
            end = int(starts[1]) if len(starts) > 1 else rows.num_rows
            if first == skipping:
                skipped += end
                rows = rows.slice(end)
                if not rows.num_rows:
                    continue
                starts = _starts(rows, by)
            yield None, skipping, skipped
            skipping = None
        last = int(starts[-1])
        if most is not None and rows.num_rows - last > most:
            skipping = tuple(rows.column(name)[last].as_py() for name in by)
            skipped = rows.num_rows - last
            rows, starts = rows.slice(0, last), starts[:-1]
        elif rows.num_rows < ROWS_AT_ONCE:
            held = rows
            continue
        else:
            held, rows, starts = rows.slice(last).combine_chunks(), rows.slice(0, last), starts[:-1]
        if rows.num_rows:
            yield rows.combine_chunks(), np.append(starts, rows.num_rows), None
    if skipping is not None:
        yield None, skipping, skipped
    if held is not None:
        yield held.combine_chunks(), np.append(_starts(held, by), held.num_rows), None


def _without_large(rows: pa.Table, starts: np.ndarray, by: list[str], most: int) -> tuple:
    sizes = np.diff(starts)
    large = [(tuple(rows.column(n)[int(s)].as_py() for n in by), int(k)) for s, k in zip(starts[:-1][sizes > most], sizes[sizes > most])]
    keep = np.repeat((sizes > 1) & (sizes <= most), sizes)
    rows = rows.filter(pa.array(keep))
    kept = sizes[(sizes > 1) & (sizes <= most)]
    return rows, np.concatenate([[0], np.cumsum(kept)]), large


def compare_in_buckets(
    rows: DataFrame, by: list[str], split_by: list[str], kernel: Kernel, returns: StructType, most: int = 4096
) -> DataFrame:
    """``returns`` rows of ``kernel`` over all buckets of ``rows``; ``rows`` is evaluated twice if a bucket is large.

    ``by`` are non-null long columns that name the bucket. A bucket of up to ``most`` rows is compared in one task.
    A larger one is only counted there; a second pass cuts it into parts by a hash of ``split_by`` and compares each
    pair of parts in a group of its own, so no task holds more than about ``most`` rows of it and every pair of
    rows still meets once. The result is a written table.
    """
    over = [StructField(f"over_{name}", LongType()) for name in by] + [StructField("over_rows", LongType())]
    whole = StructType([*returns.fields, *over])
    arrow = pa.schema([pa.field(f.name, _arrow_type(f)) for f in whole.fields])

    def filled(found: pa.RecordBatch | None, large: list) -> Iterator[pa.RecordBatch]:
        if found is not None and found.num_rows:
            columns = [found.column(f.name) for f in returns.fields] + [pa.nulls(found.num_rows, pa.int64())] * len(over)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        if large:
            columns = [pa.nulls(len(large), arrow.field(f.name).type) for f in returns.fields]
            columns += [pa.array([key[i] for key, _ in large], pa.int64()) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in large], pa.int64())], schema=arrow)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, size in _whole_buckets(batches, by, most):
            if part is None:
                yield from filled(None, [(starts, size)])
                continue
            part, starts, large = _without_large(part, starts, by, most)
            yield from filled(kernel(part, starts, None) if part.num_rows else None, large)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, _ in _whole_buckets(batches, [*by, "part_a", "part_b"], None):
            for lo, hi in zip(starts[:-1], starts[1:]):
                group = part.slice(int(lo), int(hi - lo)).combine_chunks()
                cut = group.column("part_a")[0].as_py() != group.column("part_b")[0].as_py()
                side = group.column("side").to_numpy() if cut else None
                yield from filled(kernel(group, np.array([0, group.num_rows]), side), [])

    once = written_table(rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(first, whole), "buckets")
    found = once.where("over_rows is null").select(*returns.names)
    large = once.where("over_rows is not null").select(
        *[F.col(f"over_{name}").alias(name) for name in by], F.ceil(F.col("over_rows") / (most // 2)).cast("int").alias("parts")
    )
    if large.isEmpty():
        return found
    part = F.pmod(F.xxhash64(*split_by), F.col("parts")).cast("int")
    dealt = (
        rows.join(large, by)
        .withColumn("own", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("part_a", F.least("own", "other"))
        .withColumn("part_b", F.greatest("own", "other"))
        .withColumn("side", (F.col("own") != F.col("part_a")).cast("int"))
        .drop("own", "other", "parts")
    )
    keys = [*by, "part_a", "part_b"]
    again = written_table(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(second, whole), "buckets")
    return found.union(again.select(*returns.names))


def _arrow_type(field: StructField) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[field.dataType.simpleString().replace("bigint", "long")]


def star_links(links_a: np.ndarray, links_b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) for every row of 0..count-1 that links join to a smaller row: as few links, same components."""
    label = np.arange(count)
    while len(links_a):
        before = label.copy()
        low = np.minimum(label[links_a], label[links_b])
        np.minimum.at(label, links_a, low)
        np.minimum.at(label, links_b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = np.flatnonzero(label != np.arange(count))
    return moved, label[moved]
