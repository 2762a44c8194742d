"""The corpus pipeline: documents pass the stages in order, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, exact_dedup, mixing, quality_rules, simhash
from tidemark.llm.common import documents
from tidemark.session import materialize

STAGES = [
    ("quality rules", quality_rules.stage),
    ("exact dedup", exact_dedup.stage),
    ("simhash near-dedup", simhash.stage),
    ("mixing sources to target weights", mixing.stage),
    ("byte-level bpe", byte_bpe.stage),
]

# Encoding cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
