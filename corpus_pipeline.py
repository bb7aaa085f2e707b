"""A corpus pipeline of five operators, each over all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the shared folder and rereads as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcgraph.llm import dedup, langid, mixing, near, packing
from srcgraph.llm.staging import drop, read, stage
from srcgraph.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the corpus teaches; those without letters, or of no language likelier than not, go."""
    ship(spark)
    return langid.langid_stage(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest doc_id."""
    ship(spark)
    return dedup.dedup_stage(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id."""
    ship(spark)
    return near.near_stage(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, up to three times, in the order of their training positions."""
    return mixing.mix_stage(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", mixing_to_targets),
    ("best-fit packing", best_fit_packing),
]

#: Learned languages and token ids are beyond SQL; tests/llm/test_pipeline.py holds every stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents.

    Each stage states what it does with nulls, repeated rows, long texts and clashing columns. No documents, no rows.
    """
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage_of) in enumerate(STAGES):
        out = stage(stage_of(spark, docs, sf_dir), f"pipeline-{i}")
        drop(docs)
        docs = out
    return docs
