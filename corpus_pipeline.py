"""A training-data pipeline of five stages over ``documents``; each stage's rows are the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regweave.llm.minhash import dedup_stage
from regweave.llm.mixing import mixing_stage
from regweave.llm.packing import packing_stage
from regweave.llm.quality import quality_stage
from regweave.llm.secret_scan import secrets_stage
from regweave.session import write_once

STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Boosted trees, MinHash and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is stored once and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
