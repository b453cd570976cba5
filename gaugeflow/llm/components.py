"""Connected components of a link table, as repeated joins and minimums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.materialize import written_table


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links(a, b)``; root is the smallest node that can be reached.

    Alternates large-star and small-star steps. Each is a partial minimum by node and a join on the node, which
    adaptive execution splits for a hub; no node's neighbours are gathered. The links of a round are written to
    the shared folder, so a lost executor costs one round. Empty links give an empty result.
    """
    pairs = written_table(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = _state(pairs)
    for _ in range(max_rounds):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
            .select("col.a", "col.b")
            .where("a <> b")
            .distinct()
        )
        pairs, before = written_table(small, "links"), state
        state = _state(pairs)
        if state == before:
            roots = pairs.select(F.col("b").alias("a"), "b").distinct()
            return pairs.union(roots).select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
