"""Which ids are stored already: a Bloom filter per written file of ids, then an exact look into the files that may hold one.

Ids are dealt over ``BUCKETS`` files per batch by a hash; each file's filter consists of blocks of 32,768 bits, and an id sets
``PROBES`` bits of one block. A batch meets the filters by a join on (bucket, block), so an id is tested against one block per
file of its own bucket. With 32 bits an id a file is opened in vain for about one in three million ids. Only files that pass are
read, and compared exactly. Everything is built by the job that stores a batch, in directories of that batch, so a replay
replaces it; a batch never looks at its own directories.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, PROBES = 16, 16
#: Bits of a block, as the bitmap functions have it, and ids that one is meant for.
BLOCK_BITS, BLOCK_IDS = 32_768, 1_024
_FILTERS = "bucket int, blocks int, block int, bits binary, created_at timestamp"


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), blocks).cast("int")


def _probes(key: Column) -> Column:
    """Bit positions of an id inside its block."""
    first, step = F.xxhash64(F.lit("first"), key), F.xxhash64(F.lit("step"), key)
    low = lambda c: F.pmod(c, F.lit(BLOCK_BITS))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda k: low(low(first) + k * low(step.bitwiseOR(F.lit(1)))))


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def _files(folder: str, batch_id: int) -> str:
    return f"{folder}/files/batch_id={batch_id}"


def _filters(spark: SparkSession, folder: str) -> DataFrame:
    """All filters; an empty table is created when missing."""
    spark.createDataFrame([], _FILTERS).write.mode("ignore").parquet(f"{folder}/filters/batch_id=-1")
    return spark.read.schema(f"{_FILTERS}, batch_id long").parquet(f"{folder}/filters")


def remember(ids: DataFrame, batch_id: int, folder: str) -> None:
    """Write the ids of a batch, ``ids(id)`` without repetitions, with their filters; a replay replaces both.

    ``ids`` is read three times: pass a stored table. Files hold the ids in order, one file to a bucket.
    """
    dealt = ids.where(F.col("id").isNotNull()).select("id", _bucket(F.col("id")).alias("bucket"))
    files = dealt.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "id")
    files.write.partitionBy("bucket").mode("overwrite").parquet(_files(folder, batch_id))
    # A power of two, so that few sizes occur over all batches; the hash deals the ids evenly over the buckets.
    blocks = 1 << max(0, math.ceil(ids.count() / BUCKETS / BLOCK_IDS) - 1).bit_length()
    marked = dealt.select(
        "bucket",
        F.lit(blocks).alias("blocks"),
        _block(F.col("id"), F.lit(blocks)).alias("block"),
        F.explode(_probes(F.col("id"))).alias("position"),
    )
    made = marked.groupBy("bucket", "blocks", "block").agg(F.bitmap_construct_agg("position").alias("bits"))
    made.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/filters/batch_id={batch_id}")


def files_to_open(ids: DataFrame, batch_id: int, folder: str, horizon: str | None = None) -> list[str]:
    """Files of other batches that may hold one of ``ids(id)``."""
    filters = _filters(ids.sparkSession, folder).where(F.col("batch_id") != batch_id)
    if horizon:
        filters = filters.where(F.col("created_at") >= F.current_timestamp() - F.expr(f"INTERVAL {horizon}"))
    sizes = [r["blocks"] for r in filters.select("blocks").distinct().collect()]  # powers of two: a few
    if not sizes:
        return []
    key = F.col("id")
    asked = (
        ids.where(key.isNotNull())
        .select("id", _bucket(key).alias("bucket"), _probes(key).alias("probes"), F.explode(F.array(*map(F.lit, sorted(sizes)))).alias("blocks"))
        .withColumn("block", _block(key, F.col("blocks")))
    )
    met = asked.join(filters, ["bucket", "blocks", "block"])
    may = met.where(F.forall("probes", lambda p: _is_set(F.col("bits"), p))).select("batch_id", "bucket").distinct()
    return sorted(f"{_files(folder, r['batch_id'])}/bucket={r['bucket']}" for r in may.collect())


def stored_ids(ids: DataFrame, batch_id: int, folder: str, horizon: str | None = None) -> DataFrame:
    """Those of ``ids(id)`` that another batch has stored, exactly."""
    spark = ids.sparkSession
    files = files_to_open(ids, batch_id, folder, horizon)
    if not files:
        return spark.createDataFrame([], "id string")
    return ids.select("id").join(spark.read.schema("id string").parquet(*files), "id", "left_semi")


def compact(spark: SparkSession, folder: str, before: int) -> None:
    """Bring the ids of all batches below ``before`` into one batch's files, so that an id meets one filter for all of them.

    Run it while no batch is being stored, with ``before`` at most the latest batch, which may still be replayed. Files are written
    anew under the highest of the batches; the others' become empty.
    """
    batches = sorted(r["batch_id"] for r in _filters(spark, folder).select("batch_id").distinct().collect() if 0 <= r["batch_id"] < before)
    if len(batches) < 2:
        return
    read = spark.read.schema("id string").option("basePath", f"{folder}/files")
    everything = read.parquet(*[_files(folder, b) for b in batches]).select("id").distinct()
    whole = f"{folder}/compacted-{batches[-1]}"
    everything.write.mode("overwrite").parquet(whole)
    remember(spark.read.schema("id string").parquet(whole), batches[-1], folder)
    nothing = spark.createDataFrame([], _FILTERS)
    for batch in batches[:-1]:
        nothing.write.mode("overwrite").parquet(f"{folder}/filters/batch_id={batch}")
        spark.createDataFrame([], "id string, bucket int").write.partitionBy("bucket").mode("overwrite").parquet(_files(folder, batch))
