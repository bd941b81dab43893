"""Queries that learn from the corpus: the quality classifier and language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lm_score, rule_ensemble
from .common import table


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), target)


QUERIES = {"op6_quality_classifier": op6_quality_classifier, "op9_lm_scoring": op9_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
