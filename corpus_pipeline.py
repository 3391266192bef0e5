"""A corpus pipeline: quality, exact copies, near copies, benchmark passages, source weights.

Each stage takes what its predecessor kept and gives what it keeps, with the columns of documents; the last one adds what
the mix takes of each document. Other columns stay as they are, whatever their names (but for those five, which the last stage
sets). An empty table gives an empty one; texts may have any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayleave.llm.decontaminate import without_contaminated
from wayleave.llm.exact_dedup import without_copies
from wayleave.llm.mixing import mixed
from wayleave.llm.near_dedup import without_near_duplicates
from wayleave.llm.quality import good_documents
from wayleave.llm.shared import save, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels of rows that are not held out, predicts as good. Texts that are null, empty or repeat are scored like others; without labels all rows stay."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal normalised texts the one with the least identifier; null counts as an empty text, so of all null and empty ones one stays."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, by shingles of five words and a similarity of 0.8; rows without words stay."""
    return without_near_duplicates(docs, width=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated with passages of the benchmark; rows without words stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with their number of copies; sources weigh 1, 2, 3, repeating, null last. Rows without words have one copy, and take nothing."""
    return mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("mixing", source_weights),
]

#: SQL cannot express the classifier, the signatures or the dual; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
