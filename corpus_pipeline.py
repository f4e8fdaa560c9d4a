"""A corpus pipeline over the operators of quern.llm: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what
it returns is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontamination, near_dup, packing, repetition, secrets
from quern.llm.names import fresh
from quern.scratch import given, materialize, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id: texts within two
    bits of SimHash, or with five-word shingles of a similarity of 0.8 or more."""
    return near_dup.keep_one(docs, least=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = fresh(docs, "hits")
    return decontamination.with_hits(docs, benchmark, out=hits).where(F.size(hits) == 0).drop(hits)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by ``[kind]``."""
    return secrets.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", sequence_packing),
]

#: Hashes, alignment and tokens have no SQL; the tests hold a run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of ``documents``, each stage's result written in between.

    Nulls, empty and very long texts, ties and repeated rows mean to a stage what its operator's
    docstring says; columns beside those of documents stay until the packing.  An empty table
    gives no pieces.  Of the written tables only the last stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = given()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, begun)  # what the stage before wrote, and the stage itself on its way
    return docs
