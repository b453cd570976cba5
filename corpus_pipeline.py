"""A training corpus from raw documents: toxicity, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder and reads it
again as the next stage's documents. All stages but the last return the columns of documents, others included, whatever
their names. An empty table passes as an empty table through every stage. Null and empty texts are not toxic, copy no
item and hold no personal data; they are near-copies of each other, so one of them stays, and is packed as one end token. Rows with a
null doc_id are judged like others; of rows equal in doc_id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.common import free_name
from gaugeflow.llm.decontaminate import decontaminate
from gaugeflow.llm.packing import pack
from gaugeflow.llm.pii import sanitise
from gaugeflow.llm.simhash import keep_one
from gaugeflow.llm.toxicity import THRESHOLD, score_toxicity, train_toxicity
from gaugeflow.materialize import written_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, spans = free_name(docs.columns, "score"), free_name(docs.columns, "offending")
    return score_toxicity(docs, model, score, spans).where(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: four-word shingles, four differing bits, as the operator's contract has it."""
    return keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced."""
    return sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The trained classifier, the alignment and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
