"""A training corpus from ``documents``: bad documents, repeated passages, near copies and leaks go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again as the next
one's docs. All but the last return the columns of documents.

Edge cases: a null or empty text fails the quality rules. Rows of one id, or of none, with different texts are
different documents in each stage; rows equal in id and text pass or go together, and near dedup keeps one of them.
Ties go as each operator says. Very long texts are read whole. Extra columns, whatever their names, pass through all
stages but the last. Empty tables give no rows; without labels only the base rule decides, without a benchmark
nothing leaks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm.common import delete_folder, shared_folder, table
from trajspark.llm.decontamination import drop_contaminated
from trajspark.llm.line_dedup import drop_repeated_lines
from trajspark.llm.packing import best_fit_packing
from trajspark.llm.quality_rules import keep_good
from trajspark.llm.simhash import keep_one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By lines and sentences, as passages also repeat inside lines. n_chars follows the text. A document that loses all
    its lines stays, as an empty text."""
    out = drop_repeated_lines(docs, sentences=True).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: SQL has no hash that the fingerprints need, no tokenizer and no packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of what the stages keep. A stage's table is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads docs once and stores the pieces
    delete_folder(spark, folder)
    return packed
