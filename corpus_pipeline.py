"""Corpus preparation in stages: each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import tramline
from tramline.llm import stages
from tramline.llm.common import materialize

#: (name, function); each function takes (spark, docs, sf_dir).
STAGES = [
    ("quality rules", stages.quality_rules),
    ("quality classifier", stages.quality_classifier),
    ("near duplicates", stages.near_duplicates),
    ("packing", stages.packing),
]

#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tramline.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
