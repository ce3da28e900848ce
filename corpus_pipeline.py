"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statedit.llm import decontamination, language_id, ngram_join, packing
from statedit.llm.common import scratch_path, table

STAGES = [
    ("language_id", language_id.stage),
    ("ngram_join", ngram_join.stage),
    ("decontamination", decontamination.stage),
    ("packing", packing.stage),
]

#: The stages compress, verify and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
