"""A DataFrame with engine types and an order that is part of its value.

Visible columns live under physical names of their own (``c0``, ``c1``, ...), so any
visible name is fine, two columns may share one, and nothing clashes with the hidden
order columns (``o0``, ...).  The order is only sorted by where it can be seen: limits,
single cells, rows of a pane, digests.  Every hidden column sorts ascending.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import FLOAT, INT, SPARK_TYPES, TEXT, EngineError, column_type, hint


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    at: str  # physical column


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    fields: tuple[Field, ...]
    order: tuple[str, ...]
    #: Whether the order columns are where the rows lie in a source: no two alike, and the same at every load.
    placed: bool = False

    @property
    def schema(self) -> list[tuple[str, str]]:
        return [(f.name, f.kind) for f in self.fields]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise EngineError(f"there is no column `{name}`" + hint(name, self.names))

    def visible(self) -> DataFrame:
        """The rows in any order."""
        return self.df.select(*(F.col(f.at).alias(f.name) for f in self.fields))

    def ordered(self) -> DataFrame:
        """The rows sorted into their order."""
        return self.df.orderBy(*self.order).select(*(F.col(f.at).alias(f.name) for f in self.fields))

    def head(self, n: int) -> list[tuple]:
        """The first ``n`` rows, as a top-n that never sorts the rest."""
        rows = self.df.orderBy(*self.order).limit(n).select(*(f.at for f in self.fields)).collect()
        return [tuple(r) for r in rows]

    def count(self) -> int:
        return self.df.count()


def from_dataframe(df: DataFrame, order_by: list[str] | None = None, places: list[str] | None = None) -> Relation:
    """Adopt a DataFrame: integers widen to int, floats to float, text and bool stay.

    Rows keep the order of the scan, or that of ``order_by`` and then the scan.  ``places``
    names hidden columns that number the rows of the scan; without them the rows are numbered
    here, which keeps filters from reaching the scan.  Columns of any other type are refused
    by name, with the cast to write.
    """
    fields, columns = [], []
    places = places or []
    for i, column in enumerate(f for f in df.schema.fields if f.name not in places):
        kind = column_type(column.dataType)
        if kind is None:
            raise EngineError(
                f"column `{column.name}` has type {column.dataType.simpleString()}, which is none of int, float, text and "
                f"bool; select it with a cast, such as cast(`{column.name}` as string), or leave it out"
            )
        fields.append(Field(column.name, kind, f"c{i}"))
        columns.append(df[column.name].cast(SPARK_TYPES[kind]).alias(f"c{i}"))
    before = [df[name].alias(f"o{i}") for i, name in enumerate(order_by or [])]
    scan = [df[p] for p in places] or [F.monotonically_increasing_id()]
    keys = [*before, *(c.alias(f"o{len(before) + i}") for i, c in enumerate(scan))]
    return Relation(df.select(*columns, *keys), tuple(fields), tuple(f"o{i}" for i in range(len(keys))), bool(places))


def sort_columns(column: Column, kind: str, descending: bool) -> list[Column]:
    """Two columns that sort ascending as the one should: nulls last either way, NaN above all numbers."""
    if kind == FLOAT:
        nan = F.lit(0 if descending else 2)
        rank = F.when(column.isNull(), 3).when(F.isnan(column), nan).otherwise(1)
        value = F.when(F.isnan(column), 0.0).otherwise(-column if descending else column)
        return [rank, value]
    rank = F.when(column.isNull(), 1).otherwise(0)
    if not descending:
        return [rank, column]
    if kind == INT:
        return [rank, F.bitwise_not(column)]
    if kind == TEXT:
        # bytes as hex digits, turned around; the end of a text sorts after any digit
        turned = F.translate(F.hex(F.encode(column, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
        return [rank, F.concat(turned, F.lit("G"))]
    return [rank, ~column]
