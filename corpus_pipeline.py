"""The corpus pipeline: documents go through toxicity, line dedup, near-dedup, mixing and packing.

Each stage takes all that its predecessor kept and is written as Parquet and read again. All stages but the
last return the columns of documents; the last returns the pieces of packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.common import read_table, stored
from strandspark.llm.lines import drop_repeated_lines
from strandspark.llm.mixing import take_mix
from strandspark.llm.neardup import one_of_each
from strandspark.llm.packing import pack
from strandspark.llm.toxicity import clean_documents, fit_sample


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return clean_documents(docs, fit_sample(docs, read_table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each class of near-equal lines stays; documents that this leaves without content go."""
    return drop_repeated_lines(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order; those that it doesn't reach go."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs


#: Neither the random field nor the alignment nor the packing plan can be expressed in SQL; see tests/llm.
ORACLE_SQL = None
