"""SimHash near-duplicates with bit-sliced distance comparison.

Fingerprints are 64-bit majorities over hashed word shingles. Two of them within ``RADIUS`` bits agree on at least
``BLOCKS - RADIUS`` of ``BLOCKS`` bit blocks, so one bucket per choice of agreeing blocks holds every such pair. A
bucket stores its fingerprints as vertical bit planes: one machine word has one bit of 64 fingerprints. Differences
are added into carry-save counters, 64 distances per operation, and words whose lanes all exceed the radius
are abandoned before the remaining planes are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from gaugeflow.llm.buckets import compare_in_buckets, star_links
from gaugeflow.llm.common import blocks_of, free_name, row_key
from gaugeflow.llm.components import connected_components
from gaugeflow.materialize import written_table

WIDTH, SEED, RADIUS, BITS = 4, 42, 4, 64
#: More blocks mean rarer bucket keys and more buckets per fingerprint: 7 gives 35 buckets with keys of 27 bits.
BLOCKS = 7
#: Buckets above this many rows take the query-by-query comparison instead of shifted lanes.
SHIFTS = 64
SHINGLES_AT_ONCE = 65_536
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text; null and texts without words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - WIDTH + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WIDTH)))) if len(words) >= WIDTH else iter([b" ".join(words)])
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, count, SHINGLES_AT_ONCE):
        part = hashes[begin : begin + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks_of(batches):
        values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(values)], ["row", "doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row, doc_id, fp) of every row; ``row`` is a digest of doc_id and text."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_fingerprints, "row string, doc_id long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit ``i`` of the values, 64 values to a word."""
    words = -(-len(values) // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[: len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum bits and carry bits of three one-bit lanes."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def lanes_within(difference: Callable[[int, np.ndarray], np.ndarray], words: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, lane masks) of lanes with at most ``radius`` set difference bits, for radius up to 7.

    ``difference(plane, kept)`` gives the difference bits of the words ``kept``. Counters hold 0..7 in three bit
    planes and a sticky overflow. After every eight planes the words without a lane in reach are dropped.
    """
    kept = np.arange(words)
    ones = np.zeros(words, np.uint64)
    twos, fours, over = ones.copy(), ones.copy(), ones.copy()
    alive = np.full(words, _ALL)
    for plane in range(0, BITS, 4):
        ones, carry_a = _add(ones, difference(plane, kept), difference(plane + 1, kept))
        ones, carry_b = _add(ones, difference(plane + 2, kept), difference(plane + 3, kept))
        twos, carry = _add(twos, carry_a, carry_b)
        over |= fours & carry
        fours ^= carry
        if plane % 8 == 4:
            greater, equal = np.zeros_like(over), np.full_like(over, _ALL)
            for counter, bit in ((fours, radius >> 2 & 1), (twos, radius >> 1 & 1), (ones, radius & 1)):
                if bit:
                    equal &= counter
                else:
                    greater |= equal & counter
                    equal &= ~counter
            alive = ~(over | greater)
            stay = np.flatnonzero(alive)
            if len(stay) < len(kept):
                kept, alive = kept[stay], alive[stay]
                ones, twos, fours, over = ones[stay], twos[stay], fours[stay], over[stay]
            if not len(kept):
                break
    return kept, alive


def _lanes(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def shifted_pairs(values: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one bucket within the radius: all planes are compared with themselves shifted by 1, 2, ... lanes."""
    planes = bit_planes(values)
    words = planes.shape[1]
    padded = np.concatenate([planes, np.zeros((BITS, 2), np.uint64)], axis=1)
    first, second = [], []
    sizes = np.bincount(bucket)
    for shift in range(1, int(sizes.max())):
        skip, down = divmod(shift, 64)

        def moved(plane: int, kept: np.ndarray, skip: int = skip, down: int = down) -> np.ndarray:
            low = padded[plane, np.minimum(kept + skip, words)]
            if not down:
                return low
            return (low >> np.uint64(down)) | (padded[plane, np.minimum(kept + skip + 1, words)] << np.uint64(64 - down))

        kept, alive = lanes_within(lambda plane, kept: planes[plane, kept] ^ moved(plane, kept), words, radius)
        word, lane = _lanes(alive)
        i = kept[word] * 64 + lane
        i = i[i + shift < len(values)]
        i = i[bucket[i] == bucket[i + shift]]
        first.append(i)
        second.append(i + shift)
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, int), np.zeros(0, int))


def block_pairs(values: np.ndarray, radius: int = RADIUS, queries: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one bucket within the radius, ``queries`` values against all planes at a time."""
    planes = bit_planes(values)
    for begin in range(0, len(values), queries):
        base = begin // 64
        rest = planes[:, base:]
        words = rest.shape[1]
        asked = values[begin : begin + queries]

        def difference(plane: int, kept: np.ndarray, asked: np.ndarray = asked, rest: np.ndarray = rest, words: int = words) -> np.ndarray:
            query, word = np.divmod(kept, words)
            flip = np.where(asked >> np.uint64(plane) & np.uint64(1), _ALL, np.uint64(0))
            return rest[plane, word] ^ flip[query]

        kept, alive = lanes_within(difference, len(asked) * words, radius)
        at, lane = _lanes(alive)
        query, word = np.divmod(kept[at], words)
        i, j = begin + query, (base + word) * 64 + lane
        real = (j > i) & (j < len(values))
        yield i[real], j[real]


def _kernel(rows: pa.Table, starts: np.ndarray, side: np.ndarray | None) -> pa.RecordBatch:
    """Star links (a, b) that join the fingerprints of each bucket as their links do."""
    values = rows.column("fp").to_numpy().view(np.uint64)
    sizes = np.diff(starts)
    small = np.flatnonzero(sizes <= SHIFTS)
    linked_a, linked_b = [], []
    if len(small):
        at = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in small])
        i, j = shifted_pairs(values[at], np.repeat(np.arange(len(small)), sizes[small]))
        linked_a.append(at[i])
        linked_b.append(at[j])
    for k in np.flatnonzero(sizes > SHIFTS):
        own = values[starts[k] : starts[k + 1]]
        for i, j in block_pairs(own):
            row, root = star_links(i, j, len(own))
            linked_a.append(row + starts[k])
            linked_b.append(root + starts[k])
    if not linked_a:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
    row, root = star_links(np.concatenate(linked_a), np.concatenate(linked_b), len(values))
    signed = values.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[row]), pa.array(signed[root])], ["a", "b"])


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_components(distinct: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(node, root) of the distinct non-null fingerprints ``fp`` that link with another one."""
    keys: list[Column] = [
        F.struct(F.lit(i).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("bits"))
        for i, mask in enumerate(block_masks(blocks))
    ]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.choice", "key.bits", "fp")
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    return connected_components(compare_in_buckets(rows, ["choice", "bits"], ["fp"], _kernel, schema))


def simhash_components(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(row, doc_id, fp, root, component_id) of every row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest doc_id that links reach. Null and empty texts have fingerprint zero and link
    with each other; a null doc_id never becomes a component_id unless its whole component has none. Repeated rows stay.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = written_table(fingerprints(docs), "simhash")
    distinct = written_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = fingerprint_components(distinct, blocks).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root"), "fp").select("row", "doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, nulls last, then the smallest digest.

    Null and empty texts are one component, of rows that are equal in doc_id and text one stays, and other columns stay as they
    are whatever their names. An empty table gives an empty result.
    """
    found = simhash_components(docs, blocks)
    leader = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    row = free_name(docs.columns, "row")
    kept = found.groupBy("root").agg(leader.alias("one")).select(F.col("one.row").alias(row))
    keyed = docs.withColumn(row, row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(kept, row).dropDuplicates([row]).select(*docs.columns)


def op2_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
