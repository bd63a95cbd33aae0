"""Training-corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, mixing to
target weights, sharding.  Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns the columns of documents; the last one adds the shard and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.decontamination import clean
from cloakframe.llm.jaccard_join import keep_one
from cloakframe.llm.mixing import mix
from cloakframe.llm.quality_rules import keep
from cloakframe.llm.queries import table
from cloakframe.llm.sharding import interleave
from cloakframe.llm.storage import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the log-likelihood ratio go."""
    return keep(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    return keep_one(docs).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by their calibrated probabilities."""
    return mix(docs).where("sampled").select(COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and slot."""
    return interleave(docs.select(COLUMNS), shards=24)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

#: The stages hash, rake and align; SQL cannot express them, so the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs
