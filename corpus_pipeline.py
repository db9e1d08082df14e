"""A corpus pipeline: quality rules, near-dedup, repeated passages, mixing, packing.

``run`` writes what each stage returns as Parquet to the shared folder and reads it again
for the next one, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlake.llm import stages
from leadlake.session import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stages.quality_rules),
    ("minhash_near_dedup", stages.near_dedup),
    ("suffix_array_dedup", stages.suffix_dedup),
    ("mixing_sources", stages.mixing_sources),
    ("packing", stages.packing_sequences),
]

#: Hashing, tokenizers and signatures have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
