"""The corpus pipeline: toxic documents go, copies and near copies go, sources are mixed to their weights, and the rest is packed.

Each stage takes what the one before kept, with the columns of ``documents``, and its decisions take effect; the last one returns
the packed pieces. Near copies are documents that share 80 % of their five-word shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import exact, mixing, neardup, packing, toxicity
from riskframe.llm.common import table, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, does not call toxic."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, excerpts at the ends of each shard's run included."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", clean),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("source mixing", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each one's rows written and read again."""
    rows = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        rows = stage(spark, written(rows, f"stage{number}") if number else rows, sf_dir)
    return rows


#: The model of the first stage is fitted by gradient steps, which SQL does not express; the tests compare with a brute-force version.
ORACLE_SQL = None
