"""Written intermediate tables.

Some exact algorithms read one shuffled result twice and need both reads to see the same rows in the same
segments, also after an executor is lost. Those results are written once, as Parquet, to the shared folder
that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only in local mode with nothing set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gaugeflow-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def written_table(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gaugeflow/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
