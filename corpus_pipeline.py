"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage's result is written as Parquet to shared storage and read again, so a stage never repeats the work before it
and doesn't depend on the executors that did it. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltrace.llm._store import materialize
from voltrace.llm.mixing import mix_sources
from voltrace.llm.near import drop_near
from voltrace.llm.packing import pack_documents
from voltrace.llm.quality import quality_filter
from voltrace.llm.substrings import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class linked by close SimHashes and a Jaccard similarity of 0.8 or more of five-word shingles."""
    return drop_near(docs, percent=80, shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that stand anywhere else too."""
    return remove_repeats(docs, window=35, report=False)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened as far as no document is used more than twice and every one at least once."""
    return mix_sources(docs, max_repeats=2.0, cover=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2,048 tokens."""
    return pack_documents(docs, capacity=2048, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_to_weights),
    ("packing", pack),
]

#: Components of near-duplicates and token ids aren't SQL; the pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{number + 1}")
    return docs
