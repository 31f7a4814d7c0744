"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a frame; `run` writes each stage's rows as
Parquet to the shared folder and rereads them, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symdex.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from symdex.llm.shared import drop, materialize, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", near_duplicates.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Several stages (the classifier, MinHash) can't be said in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents`: its columns, shard and slot."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        spent, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        drop(spent)
    return docs
