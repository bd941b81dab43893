"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as the inside of a Java or Python character class.
SPACES = r"\x20\x09-\x0D"
#: The same characters as a literal string, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A plain column used inside a lambda is inlined by the optimizer and would be
    evaluated again for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def input_bytes(df: DataFrame, text_col: str) -> int:
    """The size of what ``df`` reads, as the optimizer knows it, or of its texts where it does not."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not white space; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset (tests on
    one machine) a temporary folder is made, set and removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own_root(spark)
    return root.rstrip("/")


_OWN: dict[str, str] = {}


def _own_root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidegraph-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written: rows that go to a Python worker at once, and shuffle files removed when it is done.
_WHILE_WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def materialise(df: DataFrame, name: str, rows_at_once: int = 1000, by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder, in folders by a column if one is named, and read it back.

    This cuts the lineage: a lost executor later costs a re-read, and values made by
    a task (partition numbers, ranks) stay what they were.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    wanted = _WHILE_WRITING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows_at_once)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialised inside go when the block ends, but for those handed to the function that it gives."""
    outer, made, kept = _MADE.get(), [], set()
    token = _MADE.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folders(df))
        return df

    try:
        yield keep
    finally:
        _MADE.reset(token)
        for path in made:
            if any(folder.endswith(path.rpartition("/")[2]) for folder in kept):
                if outer is not None:
                    outer.append(path)
            else:
                release(spark, path)


def _folders(df: DataFrame) -> set[str]:
    return {file.rpartition("/")[0] for file in df.inputFiles()}


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        for folder in _folders(df):
            release(df.sparkSession, folder)


def discard_part(df: DataFrame, folder: str) -> None:
    """Delete one folder of a table that was written in folders by a column."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.endswith("/" + folder):
            release(df.sparkSession, path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared root through Spark's own file system layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
