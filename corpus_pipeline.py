"""Corpus pipeline: from raw documents to a source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared folder and read again as the next stage's docs, so a lost
executor costs work of one stage only. All but the last return the columns of
documents; the last adds ``copies`` and ``target``. Empty inputs give empty
outputs at every stage; nulls, ties and repeated rows are defined by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wharf.llm.common import table
from wharf.llm.decontam import drop_contaminated
from wharf.llm.exact_dedup import drop_exact_copies
from wharf.llm.mixing import mixed_documents
from wharf.llm.simhash import drop_near_duplicates
from wharf.llm.toxicity import drop_toxic
from wharf.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained on the labels table) rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return drop_exact_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (4-word SimHash within 4 bits) the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document with its copies."""
    return mixed_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("decontamination", decontamination), ("mixing", mixing)]

#: The classifier and the shingle sets are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
