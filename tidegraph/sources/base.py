"""What a source is: a description, a schema, rows, and a version that tells whether to load again."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import Relation
from ..types import SPARK_TYPES


@dataclass(frozen=True)
class Version:
    """Opaque; two are equal or not.  An unknown version equals nothing, itself included."""

    token: object = None
    known: bool = True

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Version) and self.known and other.known and self.token == other.token

    def __hash__(self) -> int:
        return hash(self.token)


UNKNOWN = Version(known=False)


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under a plan that no earlier load shares, so rows cached for an old version are not taken for it.

    The condition is constant and goes when the plan is optimized.
    """
    token = uuid.uuid4().hex
    return df.where(F.lit(token) == F.lit(token))


class Source(ABC):
    @abstractmethod
    def describe(self) -> str: ...

    @abstractmethod
    def load(self, spark: SparkSession) -> Relation: ...

    @abstractmethod
    def version(self, spark: SparkSession) -> Version: ...

    def schema(self, spark: SparkSession) -> list[tuple[str, str]]:
        return self.load(spark).schema


@dataclass(frozen=True)
class EmptySource(Source):
    """A typed table without rows, for checking an app without its data."""

    columns: tuple[tuple[str, str], ...]

    def describe(self) -> str:
        return f"empty table of {len(self.columns)} columns"

    def load(self, spark: SparkSession) -> Relation:
        from pyspark.sql import types as T

        from ..operators.relation import from_dataframe

        return from_dataframe(spark.createDataFrame([], T.StructType([T.StructField(n, SPARK_TYPES[k]) for n, k in self.columns])))

    def version(self, spark: SparkSession) -> Version:
        return Version("empty")
