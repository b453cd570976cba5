"""Requests per caller in a trailing window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.constants import RATE_LIMIT, RATE_WINDOW_SECONDS
from gaugeflow.operators.ordered import MAX_GROUP_ROWS, running_totals


def caller(client_id: Column, client_ip: Column) -> Column:
    """Client id, else ip, else ``anonymous``; an empty text is no value."""
    return F.coalesce(F.nullif(client_id, F.lit("")), F.nullif(client_ip, F.lit("")), F.lit("anonymous"))


def rate_usage(
    log: DataFrame,
    window_s: int = RATE_WINDOW_SECONDS,
    limit: int = RATE_LIMIT,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``caller``, ``used`` and ``limited`` to each request.

    ``used`` counts the caller's requests of the last ``window_s`` seconds, both ends included, up to and
    including this one; refused requests count too. Requests of one millisecond count in ``request_id`` order.
    A request adds one when it arrives and takes it back one millisecond after its window has passed, so the
    count is a running total and a hot caller can be cut anywhere.
    """
    arrival, expiry = F.lit(1).cast("long"), F.lit(-1).cast("long")
    columns = log.columns
    keyed = log.withColumn("caller", caller(F.col("client_id"), F.col("client_ip")))
    row = F.struct(*columns)
    # An expiry carries no request, only its place in the order.
    steps = keyed.select(
        "caller",
        F.explode(
            F.array(
                F.struct(
                    F.col("received_at_ms").alias("at_ms"),
                    arrival.alias("step"),
                    F.col("request_id").alias("seq"),
                    row.alias("row"),
                ),
                F.struct(
                    (F.col("received_at_ms") + window_s * 1000 + 1).alias("at_ms"),
                    expiry.alias("step"),
                    F.col("request_id").alias("seq"),
                    F.lit(None).cast(log.schema).alias("row"),
                ),
            )
        ).alias("s"),
    ).select("caller", "s.*")
    running = running_totals(steps, ["caller"], ["at_ms", "step", "seq"], {"used": F.col("step")}, max_group_rows)
    return (
        running.where(F.col("step") == 1)
        .select("row.*", "caller", "used")
        .withColumn("limited", F.col("used") > limit)
    )
