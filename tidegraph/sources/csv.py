"""The CSV dialect: exact splitting, types inferred over all rows, errors with line numbers.

One line is one record, so a file of any size, or a folder of files with one header, is split
where Spark reads it: lines become fields in a map, the ladder int, float, bool, text is
decided for all columns in one aggregate, and typed columns are cast in the scan.  Rows keep
the order of path and place in the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relation import Field, Relation
from ..types import BOOL, FLOAT, INT, TEXT, EngineError
from .base import Source, Version, fresh

BOM = chr(0xFEFF)
#: How numbers are written.
INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
_QUOTED = re.compile(r'"((?:[^"]|"")*+)"')


def split_record(record: str) -> list[str | None] | None:
    """The fields of one line, or None where a quoted field is not closed; an empty field is null.

    A quote opens a field only as its first character, and doubled it stands for itself
    inside; what follows the closing quote up to the comma belongs to the field as it
    stands.  Any other quote is a plain character.  A field that was not quoted loses the
    white space around it if it begins or ends with a space.
    """
    fields: list[str | None] = []
    at, length = 0, len(record)
    while True:
        quoted = record.startswith('"', at)
        value = ""
        if quoted:
            found = _QUOTED.match(record, at)
            if not found:
                return None
            value, at = found.group(1).replace('""', '"'), found.end()
        end = record.find(",", at)
        end = length if end < 0 else end
        rest = record[at:end]
        if not quoted and (rest.startswith(" ") or rest.endswith(" ")):
            rest = rest.strip()
        fields.append(value + rest or None)
        if end == length:
            return fields
        at = end + 1


def _fits(column: Column, kind: str) -> Column:
    if kind == INT:
        return column.rlike(INT_PATTERN) & column.try_cast("long").isNotNull()
    if kind == FLOAT:
        return column.rlike(FLOAT_PATTERN)
    return F.lower(column).isin("true", "false")


def _typed(column: Column, kind: str) -> Column:
    if kind == INT:
        return column.try_cast("long")
    if kind == FLOAT:
        plain = F.lower(F.regexp_replace(column, r"^\+", ""))
        special = F.when(plain.rlike("^-?inf"), F.when(plain.startswith("-"), float("-inf")).otherwise(float("inf")))
        special = special.when(plain.rlike("nan$"), float("nan"))
        return F.coalesce(special, column.try_cast("double"))
    return F.lower(column) == "true" if kind == BOOL else column


def from_fields(rows: DataFrame, names: list[str], source: str, line_of: Callable[[Row], int]) -> Relation:
    """Type the columns of (path, block, at, fields); every row must have as many fields as the header.

    ``line_of`` finds the line of a row that has not.
    """
    value = [F.get("fields", F.lit(i)) for i in range(len(names))]
    bad = F.col("fields").isNull() | (F.size("fields") != len(names))
    checks = [F.min(F.when(bad, F.struct("path", "block", "at", F.size("fields").alias("n")))).alias("bad")]
    for i, v in enumerate(value):
        checks.append(F.count(v).alias(f"n{i}"))
        checks += [F.count(F.when(_fits(v, kind), 1)).alias(f"{kind}{i}") for kind in (INT, FLOAT, BOOL)]
    seen = rows.agg(*checks).first()
    if row := seen["bad"]:
        said = "a quoted field is not closed" if row["n"] is None else f"{row['n']} fields where the header has {len(names)}"
        raise EngineError(f"{row['path'] or source}, line {line_of(row)}: {said}")
    fields, columns = [], []
    for i, (name, v) in enumerate(zip(names, value, strict=True)):
        n = seen[f"n{i}"]
        kind = next((k for k in (INT, FLOAT, BOOL) if n and seen[f"{k}{i}"] == n), TEXT)
        fields.append(Field(name, kind, f"c{i}"))
        columns.append(_typed(v, kind).alias(f"c{i}"))
    order = [F.col(c).alias(f"o{i}") for i, c in enumerate(("path", "block", "at"))]
    return Relation(rows.select(*columns, *order), tuple(fields), ("o0", "o1", "o2"), placed=True)


def _header(record: str | None, source: str, line: int) -> list[str]:
    if record is None:
        raise EngineError(f"{source} has no header line")
    names = split_record(record)
    if names is None:
        raise EngineError(f"{source}, line {line}: a quoted field is not closed")
    names = [n or "" for n in names]
    if twice := next((n for n in names if names.count(n) > 1), None):
        raise EngineError(f"{source} has two columns `{twice}`")
    return names


_ROW = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("block", T.LongType()), T.StructField("at", T.LongType()),
    T.StructField("fields", T.ArrayType(T.StringType())),
])


def read_text(spark: SparkSession, text: str, source: str) -> Relation:
    """A table from CSV text that is already here."""
    lines = enumerate((x.removesuffix("\r") for x in text.removeprefix(BOM).split("\n")), 1)
    found = [(number, line) for number, line in lines if line.strip()]
    number, head = found[0] if found else (1, None)
    names = _header(head, source, number)
    rows = [("", 0, line, split_record(record)) for line, record in found[1:]]
    return from_fields(spark.createDataFrame(rows, _ROW), names, source, lambda row: row["at"])


def read_file(spark: SparkSession, path: str) -> Relation:
    """A table from a CSV file that Spark can read, or from a folder of files that share one header."""
    lines = fresh(spark.read.text(path)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"),
    )
    filled = F.trim(F.translate("value", "\t\x0b\x0c\r", "")) != ""
    # one short row for each file
    first = F.min(F.when(filled, F.struct("block", "at", "value"))).alias("head")
    heads = [(r["path"], r["head"]) for r in lines.groupBy("path").agg(first).orderBy("path").collect() if r["head"]]
    names = _header(heads[0][1]["value"].removeprefix(BOM) if heads else None, heads[0][0] if heads else path, 1)
    for file, head in heads[1:]:
        if _header(head["value"].removeprefix(BOM), file, 1) != names:
            raise EngineError(f"{file} has another header than {heads[0][0]}")
    skipped = spark.createDataFrame([(file, head["block"], head["at"]) for file, head in heads], "path string, block bigint, at bigint")
    body = lines.where(filled).join(F.broadcast(skipped), ["path", "block", "at"], "left_anti")

    def split(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            fields = [split_record(v) for v in batch.column(3).to_pylist()]
            columns = [*batch.columns[:3], pa.array(fields, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "block", "at", "fields"])

    def line_of(row: Row) -> int:
        block, at = F.col("block"), F.col("at")
        before = (block < row["block"]) | ((block == row["block"]) & (at <= row["at"]))
        return lines.where((F.col("path") == row["path"]) & before).count()

    return from_fields(body.mapInArrow(split, _ROW), names, path, line_of)


@dataclass(frozen=True)
class CsvFile(Source):
    path: str

    def describe(self) -> str:
        return f"CSV file {self.path}"

    def load(self, spark: SparkSession) -> Relation:
        if not urlparse(self.path).path.lower().endswith(".csv"):
            raise EngineError(f"`{self.path}`: only .csv files can be read here")
        return read_file(spark, self.path)

    def version(self, spark: SparkSession) -> Version:
        """Length and modification time, through Spark's file systems."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [system.getFileStatus(path), *system.listStatus(path)]
        return Version(tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)))


@dataclass(frozen=True)
class CsvText(Source):
    """CSV held in memory."""

    text: str
    name: str = "inline CSV"

    def describe(self) -> str:
        return f"{self.name}, {len(self.text)} characters"

    def load(self, spark: SparkSession) -> Relation:
        return read_text(spark, self.text, self.name)

    def version(self, spark: SparkSession) -> Version:
        import hashlib

        return Version(hashlib.sha256(self.text.encode()).hexdigest())
