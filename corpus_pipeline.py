"""From raw documents to packed sequences: five stages, each an operator of ``tidemark.llm``.

Every stage takes the documents that the one before kept, written as Parquet, and decides on all
of them; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, dedup, packing, quality, rules, simhash
from tidemark.llm.common import keep, table

# Rows that a stage hands to Python at a time. Documents are long, and both sides hold such a batch.
BATCH_ROWS = 1000

# SQL can express neither the classifier nor the stages after it.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.without_repeats(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe.tokenizer_path())


def in_small_batches(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", in_small_batches(quality_rules)),
    ("quality classifier", in_small_batches(quality_classifier)),
    ("near duplicates", in_small_batches(near_duplicates)),
    ("repeated passages", in_small_batches(repeated_passages)),
    ("packing", in_small_batches(packed_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
