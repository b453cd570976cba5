"""Continuous admission: each micro-batch of requests is answered, published and remembered.

The latest run of each idempotency key is keyed state, a row for each group of keys: a micro-batch reads and writes the groups
of its own keys. Answers are written to ``batch_id=`` directories in overwrite mode, and topic records and live feed derive from the
written answers, so a batch that is replayed after a failure decides as before and replaces what it wrote. Folder and
checkpoint belong together: a new checkpoint has no state and counts its batches from zero, and needs a new folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.constants import RATE_LIMIT, RATE_WINDOW_SECONDS
from gaugeflow.operators.admission import answers, before_limit, gate, publish_payload, to_topic_records
from gaugeflow.schemas import DISPOSITION, REQUEST_LOG
from gaugeflow.sources.writers import start_stream
from gaugeflow.streaming.aggregate import live_feed
from gaugeflow.streaming.idempotency import KEY_GROUPS, stream_idempotency_outcomes
from gaugeflow.streaming.rate import stream_rate_usage

_BATCH = T.StructField("batch_id", T.LongType())
_RECORD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
LIMITED_LOG = T.StructType([*REQUEST_LOG.fields, T.StructField("limited", T.BooleanType())])

Publish = Callable[[DataFrame, int], None]


def _partition(path: str, name: str, batch_id: int) -> str:
    return f"{path}/{name}/batch_id={batch_id}"


def _table(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, _BATCH])).parquet(f"{path}/{name}")


def create_tables(spark: SparkSession, path: str) -> None:
    """Empty tables below ``path`` where there are none."""
    for name, schema in (("dispositions", DISPOSITION), ("topic", _RECORD), ("feed", T.StructType([_RECORD["value"]]))):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(_partition(path, name, -1))


def stream_admit(requests: DataFrame, clients: DataFrame, key_groups: int = KEY_GROUPS) -> DataFrame:
    """The answer to each request of a stream, as ``admit`` gives for a table, from keyed state.

    A boolean column ``limited`` marks calls over the rate limit, see ``limited_requests``.
    """
    limited = F.col("limited") if "limited" in requests.columns else None
    columns = [c for c in requests.columns if c != "limited"]
    gated = gate(before_limit(requests, clients), columns, limited)
    flat = gated.withColumns({"refusal_status": F.col("refusal.status"), "refusal_reason": F.col("refusal.reason")}).drop("refusal")
    decided = stream_idempotency_outcomes(
        flat,
        status_col="run_status",
        response_col="run_errors",
        eligible=F.col("refusal_reason").isNull(),
        carry=flat.columns,
        key_groups=key_groups,
    )
    refusal = F.when(F.col("refusal_reason").isNotNull(), F.struct(F.col("refusal_status").alias("status"), F.col("refusal_reason").alias("reason")))
    return answers(decided.withColumn("refusal", refusal), columns)


def write_answers(batch: DataFrame, batch_id: int, path: str, publish: Publish | None = None) -> None:
    """Write the answers of one micro-batch and what derives from them. The tables must exist."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(_partition(path, "dispositions", batch_id))
    # All that follows is read from the written answers, so that they agree.
    payload = publish_payload(spark.read.schema(DISPOSITION).parquet(_partition(path, "dispositions", batch_id)))
    live_feed(payload).write.mode("overwrite").parquet(_partition(path, "feed", batch_id))
    records = to_topic_records(payload)
    if publish is None:
        records.write.mode("overwrite").parquet(_partition(path, "topic", batch_id))
    else:
        publish(records, batch_id)


def run_admission(
    requests: DataFrame,
    clients: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    publish: Publish | None = None,
    key_groups: int = KEY_GROUPS,
) -> StreamingQuery:
    """Start the gateway over a stream of ``REQUEST_LOG`` rows, or of ``LIMITED_LOG`` rows where calls are limited.

    Below ``path`` each batch adds its answers (``dispositions``), topic records (``topic``) and live feed (``feed``).
    ``publish(records, batch_id)`` sends the records elsewhere instead of ``topic``; it is called again when a batch is replayed.

    Batches taken one after the other give what ``admit`` gives for the whole log, as long as no request comes in a
    later batch than its successors; such a one is decided from the state they left. Every request gets its answer.
    ``key_groups`` is fixed for a checkpoint, see ``stream_idempotency_outcomes``.
    """
    create_tables(requests.sparkSession, path)

    def answer(batch: DataFrame, batch_id: int) -> None:
        write_answers(batch, batch_id, path, publish)

    found = stream_admit(requests.select(*[c for c in LIMITED_LOG.fieldNames() if c in requests.columns]), clients, key_groups)
    writer = found.select(*DISPOSITION.fieldNames()).writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
    return (writer.trigger(**trigger) if trigger else writer).start()


def limited_requests(requests: DataFrame, clients: DataFrame, window_s: int = RATE_WINDOW_SECONDS, limit: int = RATE_LIMIT) -> DataFrame:
    """``requests`` of a stream with ``limited``; only requests that reach the limiter are counted by it."""
    checked = before_limit(requests, clients)
    columns = requests.columns
    reaching = checked.where(F.col("refusal").isNull()).select(*columns, "client_id")
    counted = stream_rate_usage(reaching, window_s, limit).select(*columns, "limited")
    return counted.unionByName(checked.where(F.col("refusal").isNotNull()).select(*columns, F.lit(False).alias("limited")))


def run_limiter(
    requests: DataFrame,
    clients: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    window_s: int = RATE_WINDOW_SECONDS,
    limit: int = RATE_LIMIT,
) -> StreamingQuery:
    """Start the limiter: every request goes on to ``path``, marked whether it is over the limit.

    Callers and idempotency keys are two states that time out by the clock, which Spark keeps in two queries. ``run_admission`` takes
    ``read_limited(spark, path)``; both together give what ``admit`` gives with ``rate_limit``.
    """
    spark = requests.sparkSession
    spark.createDataFrame([], LIMITED_LOG).write.mode("ignore").parquet(path)
    found = limited_requests(requests, clients, window_s, limit)
    return start_stream(found.select(*LIMITED_LOG.fieldNames()), path, checkpoint, trigger=trigger)


def read_limited(spark: SparkSession, path: str) -> DataFrame:
    """What ``run_limiter`` wrote, as a stream."""
    return spark.readStream.schema(LIMITED_LOG).parquet(path)


def admitted(spark: SparkSession, path: str) -> DataFrame:
    """All answers that ``run_admission`` wrote."""
    return _table(spark, path, "dispositions", DISPOSITION).drop("batch_id")


def published(spark: SparkSession, path: str) -> DataFrame:
    """All topic records that ``run_admission`` wrote."""
    return _table(spark, path, "topic", _RECORD).drop("batch_id")


def fed(spark: SparkSession, path: str) -> DataFrame:
    """Everything that ``run_admission`` wrote for live subscribers."""
    return _table(spark, path, "feed", T.StructType([_RECORD["value"]])).drop("batch_id")
