"""Storage consumer: each message stored once by id, bad messages to the dead letters.

Every micro-batch writes its own ``batch_id=`` directory in overwrite mode, cut by event date and sorted by device and type, and
compares with the other batches' ids only. A batch that is replayed after a failure therefore replaces what it wrote before. One writer
per table: two streams into one table could both store an id.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.functions.eventtime import event_time
from gaugeflow.operators.dedup import dedup_first
from gaugeflow.operators.storage_rules import stored_events, with_stored_columns
from gaugeflow.schemas import EVENT_DATE, STORED_EVENT
from gaugeflow.sources.writers import write_dlq
from gaugeflow.streaming.membership import remember, stored_ids


def index_of(path: str) -> str:
    """Folder of the index of stored ids beside the table."""
    return f"{path}_ids"


def store_events(
    batch: DataFrame, batch_id: int, path: str, order: list[str], horizon: str | None = None
) -> None:
    """Insert the batch's events whose id is not stored; the first of equal ids in ``order`` wins.

    Stored ids are found by the index beside the table: Bloom filters name the files of ids that may hold one of the
    batch's, and only these are read. ``horizon`` (such as ``"7 days"``) leaves out batches loaded before, where redeliveries are
    known to come within that time.
    """
    firsts = dedup_first(batch, "id", order).drop(*[c for c in order if c not in STORED_EVENT.fieldNames()]).persist()
    try:
        fresh = firsts.join(stored_ids(firsts.select("id"), batch_id, index_of(path), horizon), "id", "left_anti")
        (
            fresh.withColumn("created_at", F.current_timestamp())
            .select(*[f.name for f in STORED_EVENT])
            .withColumn(EVENT_DATE, F.to_date(event_time(F.col("timestamp"))))
            .hint("rebalance", EVENT_DATE)
            .sortWithinPartitions(EVENT_DATE, "device_id", "event_type", "timestamp")
            .write.partitionBy(EVENT_DATE)
            .mode("overwrite")
            .parquet(f"{path}/batch_id={batch_id}")
        )
        remember(batch.sparkSession.read.schema("id string").parquet(f"{path}/batch_id={batch_id}"), batch_id, index_of(path))
    finally:
        firsts.unpersist()


def _store_held(checked: DataFrame, batch_id: int, path: str, dlq_path: str, horizon: str | None = None) -> None:
    order = [c for c in ("partition", "offset") if c in checked.columns]
    good = stored_events(checked.where(F.col("reason").isNull()), *order)
    write_dlq(checked.where(F.col("reason").isNotNull()), f"{dlq_path}/batch_id={batch_id}", mode="overwrite")
    # Messages without a place in the topic are ordered by what they hold, so that a replay stores the same one.
    store_events(good, batch_id, path, order or [c for c in good.columns if c != "id"], horizon)


def store_checked(checked: DataFrame, batch_id: int, path: str, dlq_path: str, horizon: str | None = None) -> None:
    """One checked micro-batch: good rows to the table, bad rows to the dead letters."""
    checked = checked.persist()
    try:
        _store_held(checked, batch_id, path, dlq_path, horizon)
    finally:
        checked.unpersist()


def store_batch(messages: DataFrame, batch_id: int, path: str, dlq_path: str, horizon: str | None = None) -> None:
    """Check and store one batch of topic messages."""
    store_checked(with_stored_columns(messages), batch_id, path, dlq_path, horizon)


def run_storage(
    stream: DataFrame,
    path: str,
    dlq_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    horizon: str | None = None,
    log_path: str | None = None,
) -> StreamingQuery:
    """Start the consumer. Offsets are committed after both writes; a failure before that replays the batch.

    ``processed`` (duplicates included) and ``failed`` messages of each batch are in the query progress, as
    the observed metric ``storage``. Spark keeps the progress of recent batches only; with ``log_path`` every batch also
    writes one row (batch_id, duration_ms, processed, failed) there, which a replay overwrites.
    """
    checked = with_stored_columns(stream).observe(
        "storage",
        F.count_if(F.col("reason").isNull()).alias("processed"),
        F.count_if(F.col("reason").isNotNull()).alias("failed"),
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            begun = time.monotonic()
            _store_held(batch, batch_id, path, dlq_path, horizon)
            if log_path:
                took = F.lit(round((time.monotonic() - begun) * 1000)).cast("long").alias("duration_ms")
                good, bad = (F.count_if(test).alias(name) for test, name in ((F.col("reason").isNull(), "processed"), (F.col("reason").isNotNull(), "failed")))
                batch.agg(good, bad).select(took, "processed", "failed").write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = checked.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(**trigger) if trigger else writer).start()


def batch_log(spark: SparkSession, log_path: str) -> DataFrame:
    """(batch_id, duration_ms, processed, failed) of every batch that ``run_storage`` logged, for the duration histogram."""
    return spark.read.schema("duration_ms long, processed long, failed long, batch_id long").parquet(log_path)
