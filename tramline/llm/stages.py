"""The pipeline's stages: each applies one operator to all its predecessor kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of docs, any
further ones included, whatever their names.
Rows that share an id are one document: they stay or go together (the classifier
alone judges each row by its text). Rows with a null id count as one document too; it
names no group of near copies, and stays if one of its texts is in no other's group. Null, empty and blank texts go in
the first stage, having no words. Texts of any length are judged and packed whole.
Ties: of equal texts the smallest id stays. An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import near_copies
from tramline.llm import packing as packer
from tramline.llm import quality_classifier as classifier
from tramline.llm import quality_rules as rules


def _with_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is among ids; texts are dealt by id, so hot sources or texts are no hot keys."""
    ids = ids.select(F.col(id_col).alias("_kept"))
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_kept"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside their language and source go."""
    return _with_ids(docs, rules.judge(docs).where("kept"), "doc_id")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go; the model learns from labelled documents among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = "_score"
    while name in docs.columns:
        name += "_"
    scored = classifier.score(docs, classifier.train(docs, labels), name=name)
    return scored.where(F.col(name) >= classifier.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more) the document with the smallest id stays."""
    found = near_copies.near_copies(docs)
    return _with_ids(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "doc_id")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences."""
    return packer.pack(docs)
