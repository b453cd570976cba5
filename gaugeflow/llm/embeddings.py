"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector belongs to every filter whose direction it exceeds a threshold on. Directions come
from ``CODES`` product codes: each rotates the vector at random and cuts it in two halves, each half has some
random unit words, and every pair of words is a direction. A vector's filters are list-decoded from its scores on the
words of each code: pairs of words whose scores add up to the threshold. Several codes even out vectors
that happen to lie far from the words of one. Vectors of one label that share a filter are compared in double precision.
The words are chosen by the vectors of the largest label: as many directions more as there are vectors, so a filter
keeps its number of vectors, and slightly more filters to a vector, so linked ones still meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gaugeflow.llm.buckets import compare_in_buckets, star_links
from gaugeflow.llm.components import connected_components
from gaugeflow.materialize import written_table

SIMILARITY = 0.93
#: Product codes, and words per half: 8 codes of 128 x 128 are 131,072 filters, for labels of up to ``VECTORS`` vectors.
CODES, CODEWORDS, VECTORS = 8, 128, 32_768
#: Words of a half at most: filters are numbered in 31 bits.
MOST_WORDS = 8_192
#: A vector's filters grow by this power of the directions.
GROWTH = 0.25
#: Filters of a vector if directions were spread evenly; about 24 in practice.
FILTERS = 40
SEED = 20_240_601
VECTORS_AT_ONCE = 256


def codewords(vectors: int) -> int:
    """Words per half for a label of so many vectors: a power of two, doubled for every four times the vectors."""
    words = CODEWORDS
    while words < MOST_WORDS and vectors > VECTORS * (words // CODEWORDS) ** 2:
        words *= 2
    return words


@lru_cache(maxsize=8)
def product_codes(dimensions: int, count: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rotation, first words, second words) of every code; the same on every worker."""
    codes, split = [], dimensions - dimensions // 2
    for number in range(CODES):
        draw = np.random.Generator(np.random.PCG64([SEED, dimensions, number]))
        rotation = np.linalg.qr(draw.standard_normal((dimensions, dimensions)))[0]
        words = [draw.standard_normal((count, width)) for width in (split, dimensions - split)]
        codes.append((rotation, *(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9) for w in words)))
    return codes


def decode(unit: np.ndarray, words: int = CODEWORDS) -> tuple[np.ndarray, np.ndarray]:
    """(vector number, filter number) of all filters that the unit vectors exceed, by vector and filter."""
    dimensions = unit.shape[1]
    share = min(FILTERS * (words / CODEWORDS) ** (2 * GROWTH) / CODES / words**2, 0.5)
    reach = NormalDist().inv_cdf(1 - share) * np.sqrt(2 / dimensions)
    rows, filters = [], []
    for number, (rotation, first, second) in enumerate(product_codes(dimensions, words)):
        turned = unit @ rotation
        a, b = turned[:, : first.shape[1]] @ first.T, turned[:, first.shape[1] :] @ second.T
        row, i = np.nonzero(a >= reach - b.max(1)[:, None])
        hit, j = np.nonzero(b[row] >= reach - a[row, i][:, None])
        rows.append(row[hit])
        filters.append((number * words + i[hit]) * words + j)
    row, code = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((code, row))
    return row[order], code[order]


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components would leave the range of doubles.
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _packed_as(kind: str):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per vector: its components as bytes, null when it can't link."""
        for batch in batches:
            out = []
            for vector in batch.column("embedding").to_pylist():
                ok = vector and None not in vector
                values = np.array(vector, kind) if ok else None
                out.append(values.tobytes() if ok and np.isfinite(values).all() and values.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "bytes"])

    return packed


def _by_size(raw: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors in double precision) for each vector length."""
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield own, _unit(np.frombuffer(b"".join(raw[k] for k in own), kind).reshape(len(own), -1).astype(np.float64))


def _decoded_from(kind: str, words: int):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTORS_AT_ONCE):
                part = batch.slice(begin, VECTORS_AT_ONCE)
                lists: list = [None] * part.num_rows
                for own, unit in _by_size(part.column("bytes").to_pylist(), kind):
                    row, code = decode(unit, words)
                    cuts = np.searchsorted(row, np.arange(len(own) + 1))
                    for at, k in enumerate(own):
                        lists[k] = code[cuts[at] : cuts[at + 1]].astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.binary())], [*part.schema.names, "filters"])

    return decoded


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each filter of each vector."""
    for batch in batches:
        lists = [np.frombuffer(x, np.int32) for x in batch.column("filters").to_pylist()]
        for begin in range(0, len(lists), VECTORS_AT_ONCE):
            part = lists[begin : begin + VECTORS_AT_ONCE]
            take = np.repeat(np.arange(begin, begin + len(part)), [len(x) for x in part])
            rows = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.concatenate([*part, np.zeros(0, np.int32)]).astype(np.int64))], [*rows.schema.names, "filter"]
            )


def _linked(rows: pa.Table, side: np.ndarray | None, similarity: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one bucket that link and have no smaller filter in common: each pair counts in one bucket."""
    raw = rows.column("bytes").to_pylist()
    n, own = len(raw), int(rows.column("filter")[0].as_py())
    linked = np.zeros((n, n), bool)
    for at, unit in _by_size(raw, kind):
        linked[np.ix_(at, at)] = unit @ unit.T >= similarity
    if side is not None:
        linked &= side[:, None] != side[None, :]
    linked &= np.triu(np.ones((n, n), bool), 1)
    if linked.any():
        lists = [np.frombuffer(x, np.int32) for x in rows.column("filters").to_pylist()]
        before = [x[x < own] for x in lists]
        codes, place = np.unique(np.concatenate(before), return_inverse=True)
        member = np.zeros((n, len(codes)), np.float32)
        member[np.repeat(np.arange(n), [len(x) for x in before]), place] = 1
        linked &= member @ member.T == 0
    return np.nonzero(linked)


def _kernel_at(similarity: float, kind: str):
    def kernel(rows: pa.Table, starts: np.ndarray, side: np.ndarray | None) -> pa.RecordBatch:
        """(a, b, n): a has n more links (b null), or a and b are in one component (n null)."""
        ids, copies = rows.column("cid").to_numpy(), rows.column("copies").to_numpy()
        links = np.zeros(len(ids), np.int64)
        moved, roots = [], []
        for lo, hi in zip(starts[:-1], starts[1:]):
            i, j = _linked(rows.slice(int(lo), int(hi - lo)), side, similarity, kind)
            if len(i):
                np.add.at(links, i + lo, copies[j + lo])
                np.add.at(links, j + lo, copies[i + lo])
                row, root = star_links(i, j, int(hi - lo))
                moved.append(row + lo)
                roots.append(root + lo)
        counted = np.flatnonzero(links)
        row = np.concatenate([*moved, np.zeros(0, np.int64)]).astype(np.int64)
        root = np.concatenate([*roots, np.zeros(0, np.int64)]).astype(np.int64)
        a = np.concatenate([ids[counted], ids[row]])
        b = pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(ids[root])])
        n = pa.concat_arrays([pa.array(links[counted]), pa.nulls(len(row), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(a), b, n], ["a", "b", "n"])

    return kernel


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, most: int = 1024, words: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label, ...)``.

    Only rows of one non-null label are compared. A vector that is null, empty, zero or holds a null, NaN or
    infinite component links with nothing, and is kept. Equal vectors are one class that links within itself, so copies are
    counted, not compared. Vectors of different length never link. Repeated rows stay and link with each other; a row with
    a null vec_id takes the smallest id that it reaches. An empty table gives an empty result.
    """
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    embedding = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), embedding.alias("embedding"))
    rows = rows.mapInArrow(_packed_as(kind), "vec_id long, label long, bytes binary").withColumn(
        "class", F.when(F.col("label").isNotNull() & F.col("bytes").isNotNull(), F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b"/"), "bytes")))
    )
    rows = written_table(rows, "vectors")
    classes = written_table(
        rows.where("class is not null")
        .groupBy("class")
        .agg(F.first("label").alias("label"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    if words is None:
        words = codewords(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    decoded = classes.select("cid", "label", "copies", "bytes").mapInArrow(
        _decoded_from(kind, words), "cid long, label long, copies long, bytes binary, filters binary"
    )
    dealt = decoded.mapInArrow(_exploded, "cid long, label long, copies long, bytes binary, filters binary, filter long")
    schema = StructType([StructField(x, LongType()) for x in "abn"])
    found = compare_in_buckets(dealt, ["label", "filter"], ["cid"], _kernel_at(similarity, kind), schema, most)
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("cid"), "root")
    rooted = classes.join(roots, "cid", "left").select("cid", "class", "copies", "least", F.coalesce("root", "cid").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("least_of_all"))
    per_class = (
        rooted.join(named, "root")
        .join(counts, "cid", "left")
        .select("class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "least_of_all")
    )
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("least_of_all"))
    return rows.join(per_class, "class", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
