"""The corpus pipeline: toxicity, exact dedup, near-duplicates, mixture, packing.

``run(spark, sf_dir)`` reads ``documents``; each stage gets what its predecessor kept, written as
Parquet to the shared folder and read again. All stages but the last return the columns of
``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerocal.llm.common import table
from aerocal.llm.exact_dedup import drop_copies
from aerocal.llm.jaccard_join import keep_one_each
from aerocal.llm.mixing import sample_mixture
from aerocal.llm.packing import pack_documents
from aerocal.llm.toxicity import drop_toxic, fit_toxicity
from aerocal.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model of these documents and the labels."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; the largest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word Jaccard 0.8 links; the smallest id stays."""
    return keep_one_each(docs, words=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens follow the tempered marginals."""
    return sample_mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("packing", packing),
]

#: The toxicity model and the tokenizer have no SQL form; tests hold run() against the operators
#: and brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
