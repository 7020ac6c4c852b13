"""A corpus pipeline: quality rules, near-dedup, decontamination, surrogates, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankwell.llm import decontam, minhash, packing, pii, quality
from rankwell.llm.common import discard, doc_columns, materialise, small, table

#: Up to this many ids of dropped documents are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the model go."""
    return doc_columns(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays."""
    gone = materialise(minhash.near_duplicates(docs).where("not kept").select("doc_id"), "gone")
    return doc_columns(docs).join(small(gone, BROADCAST_IDS), "doc_id", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark go."""
    return doc_columns(decontam.find_contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates."""
    return doc_columns(pii.replace_entities(docs, pii.session_key(spark)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii surrogates", pii_surrogates),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the trained model nor the packing; a test compares each stage with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            discard(last)  # the stage before is not read again
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
