"""A training corpus in five stages, each an operator of molmill.llm over all that the one before it kept.

Rows keep the columns of documents until the last stage adds shard and slot. Every stage
takes nulls in any column, empty and very long texts, repeated rows, empty tables and
extra columns, as its operator does.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from molmill.llm.common import scratch, table
from molmill.llm.decontam import drop_contaminated
from molmill.llm.mix import mix_documents
from molmill.llm.quality import drop_low_quality
from molmill.llm.shard import shard_rows
from molmill.llm.simhash import drop_near_copies

SHARDS = 24


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labels, takes for quality 1."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return drop_near_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are hit by benchmark windows."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mix_documents(docs)


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return shard_rows(docs, SHARDS, ["doc_id", "source", "lang", "n_chars"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix),
    ("sharding", deal),
]

ORACLE_SQL = None  # a fitted classifier has no form in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
