"""From raw documents to packed training sequences, one stage after the other.

An empty table passes through every stage; columns that a stage does not name are carried along.

Every stage takes what its predecessor kept and returns the columns of ``documents``;
the last returns the packed pieces.  Between stages the rows are written as Parquet in
the folder of ``spark.checkpoint.dir`` and read again, so a lost executor never costs
more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import decontaminate, jaccard, pii, quality
from tidegraph.llm.common import materialise, table
from tidegraph.llm.queries_tokens import pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Every row is judged by its text alone: null, empty and blank texts have fewer than 20
    words and go, repeated rows fare alike, ids do not matter.
    """
    return quality.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: word 5-shingles, similarity 0.8 or more.

    It is the one of the smallest id; of rows that share that id, or of a group without
    ids, any one.  Rows without words are no duplicates of each other.
    """
    return jaccard.keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Every row is judged by its text alone, whatever its id; null and empty texts hold nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every row stays, null texts as they are."""
    return pii.redact_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048.

    Null and empty texts are one piece of the end id; rows that repeat an id are packed each for itself.
    """
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SQL cannot express tokenization and edit matching; tests hold the stages against brute force.
ORACLE_SQL = None
