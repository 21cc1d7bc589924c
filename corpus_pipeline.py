"""From raw documents to encoded ones: classifier, rules, near-duplicates, mix, encoding.

Each stage works on all that the one before kept, written as Parquet in shared storage and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import pipeline_stages as stages
from graphloom.llm.common import materialised

STAGES = [
    ("quality classifier", stages.classified),
    ("quality rules", stages.ruled),
    ("near-duplicates", stages.deduplicated),
    ("source mix", stages.weighted),
    ("bpe encoding", stages.encoded),
]
#: A trained classifier and BPE are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
