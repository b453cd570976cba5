"""Client lookup by API key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIENT_COLUMNS = ("client_id", "client_name", "client_active")


def attach_client(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Left lookup on ``api_key``; unknown keys keep null client columns.

    One client per key (the oldest) reaches the join, so requests never multiply. No broadcast is forced:
    Catalyst broadcasts the clients while they are below its size limit, and beyond it the join shuffles, with
    the request side of a hot key split by adaptive execution.
    """
    lookup = clients.groupBy("api_key").agg(
        F.min_by(F.struct("id", "name", "active"), F.struct("created_at", "id")).alias("__client")
    )
    return (
        requests.join(lookup, "api_key", "left")
        .withColumns(
            {
                "client_id": F.col("__client.id"),
                "client_name": F.col("__client.name"),
                "client_active": F.col("__client.active"),
            }
        )
        .drop("__client")
    )


def upsert_clients_if_absent(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing clients plus the new ones whose ``api_key`` is not taken, first of equal keys only.

    A column that ``new`` leaves out gets its default: an active client, created now, with a random id (also where the
    id is null). Write the result before using it twice: random ids differ between evaluations.
    """
    defaults = {"active": F.lit(True), "created_at": F.current_timestamp()}
    left_out = [f for f in existing.schema if f.name not in new.columns]
    new = new.withColumns({f.name: defaults.get(f.name, F.lit(None)).cast(f.dataType) for f in left_out})
    fresh = new.join(existing.select("api_key"), "api_key", "left_anti")
    others = [c for c in new.columns if c != "api_key"]
    first = (
        fresh.groupBy("api_key")
        .agg(F.min_by(F.struct(*others), F.struct(F.col("id").isNull(), *sorted(others, key=lambda c: c != "id"))).alias("__row"))
        .select("api_key", "__row.*")
    )
    return existing.unionByName(first.withColumn("id", F.coalesce("id", F.expr("uuid()"))))
