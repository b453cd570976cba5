"""Running totals in order, exact for groups of any size.

A window over a group runs in one task. Groups up to ``max_group_rows`` go that way. A larger group is cut
into consecutive segments by a range shuffle on (group, order); each segment keeps its own running totals, and
the totals of the segments before it are added. Only one row per segment is needed for that. A segment holds
about as many rows as a group may have: few enough to sort in a task, many enough to keep the segments few.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gaugeflow.materialize import written_table

MAX_GROUP_ROWS = 8_000_000
SEGMENT = "__segment"
_TIE = "__tie"


class LargeGroups(NamedTuple):
    """Groups too large for one task: a small written table of their keys, and their rows in total (0 if none)."""

    keys: DataFrame
    rows: int


def large_groups(df: DataFrame, by: Sequence[str], max_rows: int) -> LargeGroups:
    """Groups above about ``max_rows``; reads the group columns only.

    With a high bound one row in 64 is counted, so that finding the large groups does not shuffle every key.
    The count only chooses the way a group is computed, never its result. A group is found from half its
    expected count on: for a group of twice the bound that is a quarter of at least 64 rows.
    """
    exact = max_rows < 64 * 32
    step = 1 if exact else 64
    counted = df if exact else df.sample(1 / step, seed=1)
    least = max_rows if exact else max_rows / step / 2
    counts = (
        counted.groupBy(*by).agg((F.count(F.lit(1)) * step).alias("__rows")).where(F.col("__rows") > least * step)
    )
    total = Observation()
    keys = written_table(counts.observe(total, F.sum("__rows").alias("rows")).drop("__rows"), "large-groups")
    return LargeGroups(keys, total.get["rows"] or 0)


def same_group(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    """Null-safe equality of the group columns."""
    condition = F.lit(True)
    for name in by:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def range_segments(df: DataFrame, by: Sequence[str], order: Sequence[str], segments: int) -> DataFrame:
    """Rows cut into ``segments`` consecutive ranges of (by, order), numbered by ``__segment``, written once.

    Range bounds come from a sample, so two evaluations may cut differently: the cut is written before use.
    Equal rows are told apart by a running number, so that even a group of exact copies is cut.
    """
    cut = (
        df.withColumn(_TIE, F.monotonically_increasing_id())
        .repartitionByRange(segments, *by, *order, _TIE)
        .withColumn(SEGMENT, F.spark_partition_id())
    )
    return written_table(cut, "segments")


def _running_small(df: DataFrame, by: Sequence[str], order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: F.sum(value).over(window) for name, value in totals.items()})


def _running_segmented(
    df: DataFrame, by: Sequence[str], order: Sequence[str], totals: dict[str, Column], segments: int
) -> DataFrame:
    cut = range_segments(df, by, order, segments)
    local = _running_small(cut, [*by, SEGMENT], [*order, _TIE], totals)
    before = Window.partitionBy(*by).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    # Only the first group of a segment continues from the segment before: at most one row per segment.
    carried = (
        cut.groupBy(*by, SEGMENT)
        .agg(*[F.sum(value).alias(name) for name, value in totals.items()])
        .withColumn("__first", F.min(SEGMENT).over(Window.partitionBy(*by)))
        .withColumns({f"__before_{name}": F.sum(name).over(before) for name in totals})
        .where(F.col(SEGMENT) > F.col("__first"))
        .select(
            F.col(SEGMENT).alias("__at"),
            *[F.col(name).alias(f"__of_{name}") for name in by],
            *[f"__before_{name}" for name in totals],
        )
    )
    same = F.col(SEGMENT) == F.col("__at")
    for name in by:
        same = same & F.col(name).eqNullSafe(F.col(f"__of_{name}"))
    joined = local.join(F.broadcast(carried), same, "left")
    return joined.select(
        *df.columns,
        *[
            F.coalesce(F.col(name) + F.col(f"__before_{name}"), name, f"__before_{name}").alias(name)
            for name in totals
        ],
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``totals``, each the sum of its expression over the group up to and including the row.

    ``order`` must decide between rows that differ. Integer and decimal sums are exact and repeatable.
    """
    big = large_groups(df, by, max_group_rows)
    if not big.rows:
        return _running_small(df, by, order, totals)
    small_part = df.join(big.keys, same_group(df, big.keys, by), "left_anti")
    big_part = df.join(big.keys, same_group(df, big.keys, by), "left_semi")
    segments = max(2, math.ceil(big.rows / max_group_rows))
    return _running_small(small_part, by, order, totals).unionByName(
        _running_segmented(big_part, by, order, totals, segments)
    )
