"""A corpus pipeline of five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridevents.llm import stages
from gridevents.session import written

#: Every function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality rules", stages.quality_rules),
    ("near dedup", stages.near_dedup),
    ("substring dedup", stages.substring_dedup),
    ("secret scan", stages.secret_scan),
    ("packing", stages.packing),
]

#: zstandard ratios and signatures have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
