"""Best-fit-decreasing packing of groups of equal texts into a fixed number of shards.

Groups are placed in order of size, each into the shard with the tightest remaining capacity that holds it. Groups of
one size are interchangeable, so the placement is planned on the number of groups by size: at most
sqrt(2 x total bytes) different sizes exist, and the driver sees only these counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import numbered, with_row_number
from gaugeflow.materialize import written_table

SHARDS, OVERHEAD = 24, 8


def _priority(key: tuple[int, int]) -> int:
    """A checksum of the key: as good as random, which keeps the tree balanced, and the same in every run."""
    return zlib.crc32(repr(key).encode())


class Treap:
    """Balanced search tree of (remaining capacity, shard)."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _split(node, key):
        """Trees with the entries below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = Treap._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = Treap._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    @staticmethod
    def _merge(low, high):
        if low is None or high is None:
            return low or high
        if low[1] < high[1]:
            return low[0], low[1], low[2], Treap._merge(low[3], high)
        return high[0], high[1], Treap._merge(low, high[2]), high[3]

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, (key, _priority(key), None, None)), high)

    def remove(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        _, high = self._split(high, (key[0], key[1] + 1))
        self.root = self._merge(low, high)

    def at_least(self, key: tuple[int, int]) -> tuple[int, int] | None:
        node, found = self.root, None
        while node is not None:
            if node[0] >= key:
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found

    def largest(self) -> tuple[int, int]:
        node = self.root
        if node is None:
            raise LookupError("the tree is empty")
        while node[3] is not None:
            node = node[3]
        return node[0]


def plan_shards(counts: Iterable[tuple[int, int]], shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """Runs (group size, first number, shard) for (group size, number of groups).

    The capacity is an equal share of all bytes. Groups above the share of what is left get a shard of their own
    and the share is taken anew. When no shard has room, the group enters the one with most room.
    """
    ordered = sorted(counts, reverse=True)
    total, free, runs, alone = sum(s * c for s, c in ordered), list(range(shards)), [], {}
    for size, count in ordered:
        while alone.get(size, 0) < count and len(free) > 1 and size * len(free) > total:
            runs.append((size, alone.get(size, 0), free.pop(0)))
            alone[size] = alone.get(size, 0) + 1
            total -= size
        if alone.get(size, 0) < count:
            break
    share, tree = -(-total // len(free)), Treap()
    for shard in free:
        tree.add((share, shard))
    for size, count in ordered:
        number = alone.get(size, 0)
        while number < count:
            room, shard = tree.at_least((size, -1)) or tree.largest()
            taken = max(1, min(count - number, room // size))
            tree.remove((room, shard))
            tree.add((room - taken * size, shard))
            runs.append((size, number, shard))
            number += taken
    return runs


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs(doc_id, text, ...)``.

    Rows with equal texts stay together; null texts are one group of their own, with size ``OVERHEAD`` and checksum
    0. Repeated rows count each; a null doc_id stays. An empty table gives an empty result. A group above an equal share fills
    a shard alone and exceeds it: groups are never cut.
    """
    rows = written_table(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.unhex(F.coalesce(F.sha2("text", 256), F.lit(""))).alias("same"),
        ),
        "documents",
    )
    groups = written_table(with_row_number(rows.groupBy("same").agg(F.sum("size").alias("bytes"))), "groups")
    counts = [(r["bytes"], r["count"]) for r in groups.groupBy("bytes").count().toLocalIterator()]
    runs: dict[int, list] = {}
    for size, first, shard in plan_shards(counts, shards):
        runs.setdefault(size, []).append((first, shard))
    plan = docs.sparkSession.createDataFrame(list(runs.items()), "bytes long, runs array<struct<first:long,shard:int>>")
    placed = (
        numbered(groups, ["bytes"], ["same"], "number")
        .join(plan, "bytes")
        .select("same", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("number")), -1)["shard"].alias("shard"))
    )
    sharded = written_table(with_row_number(rows.join(placed, "same").select("doc_id", "size", "text_crc32", "shard")), "sharded")
    return numbered(sharded, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
