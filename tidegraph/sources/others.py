"""CSV over HTTP, queries over JDBC, and Parquet."""

from __future__ import annotations

import re
import urllib.error
import urllib.request
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..operators.relation import Relation, from_dataframe
from ..types import EngineError
from .base import UNKNOWN, Source, Version, fresh
from .csv import read_text

TIMEOUT_SECS, MAX_BYTES, MAX_REDIRECTS = 30, 256 << 20, 5


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = MAX_REDIRECTS


@dataclass(frozen=True)
class HttpCsv(Source):
    """CSV behind a url; too large, too slow or too many redirects is an error."""

    url: str
    timeout_secs: int = TIMEOUT_SECS

    def describe(self) -> str:
        return f"CSV at {self.url}"

    def _open(self, method: str):  # noqa: ANN202
        if not re.match(r"https?://", self.url):
            raise EngineError(f"`{self.url}` is not an http or https url")
        request = urllib.request.Request(self.url, method=method)
        return urllib.request.build_opener(_Redirects).open(request, timeout=self.timeout_secs)

    def load(self, spark: SparkSession) -> Relation:
        try:
            with self._open("GET") as answer:
                body = answer.read(MAX_BYTES + 1)
        except (urllib.error.URLError, TimeoutError) as problem:
            raise EngineError(f"{self.url}: {problem}") from problem
        if len(body) > MAX_BYTES:
            raise EngineError(f"{self.url} is larger than {MAX_BYTES} bytes")
        try:
            text = body.decode("utf-8")
        except UnicodeDecodeError as problem:
            raise EngineError(f"{self.url} is not UTF-8") from problem
        return read_text(spark, text, self.url)

    def version(self, spark: SparkSession) -> Version:
        """From the headers; a server that gives none, or no HEAD, is loaded every time."""
        try:
            with self._open("HEAD") as answer:
                told = tuple(answer.headers.get(h) for h in ("ETag", "Last-Modified", "Content-Length"))
        except urllib.error.HTTPError as problem:
            if problem.code in (405, 501):
                return UNKNOWN
            raise EngineError(f"{self.url}: {problem}") from problem
        except (urllib.error.URLError, TimeoutError) as problem:
            raise EngineError(f"{self.url}: {problem}") from problem
        return Version(told) if any(told) else UNKNOWN


@dataclass(frozen=True)
class JdbcQuery(Source):
    """One ``select`` over JDBC; Spark pushes nothing into it and reads it as it stands."""

    url: str
    query: str
    watch: str | None = None
    options: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        bare = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", self.query, flags=re.S).strip().rstrip(";")
        if not re.match(r"(?i)(select|with)\b", bare) or ";" in bare:
            raise EngineError("a source query is one `select` statement")

    def describe(self) -> str:
        return f"query over {re.sub('//[^@/]*@', '//', self.url)}"

    def _read(self, spark: SparkSession, query: str):  # noqa: ANN202
        return spark.read.format("jdbc").options(url=self.url, query=query, **dict(self.options)).load()

    def load(self, spark: SparkSession) -> Relation:
        return from_dataframe(self._read(spark, self.query.strip().rstrip(";")))

    def version(self, spark: SparkSession) -> Version:
        """Row count and, where a column is watched, its maximum."""
        seen = f"max(q.{self.watch})" if self.watch else "null"
        row = self._read(spark, f"select count(*) as n, {seen} as m from ({self.query.strip().rstrip(';')}) q").first()
        return Version((row[0], row[1]))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> Relation:
    """A Parquet table whose rows are placed by file and row number, so that filters and projections reach the scan.

    Neither place is read where no order is asked for.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    df = spark.read.parquet(path)
    places = ["_metadata.row_index as __row"] if single else ["_metadata.file_path as __file", "_metadata.row_index as __row"]
    shown = columns or [f"`{c}`" for c in df.columns]
    return from_dataframe(fresh(df.selectExpr(*shown, *places)), places=[p.rpartition(" ")[2] for p in places])


@dataclass(frozen=True)
class Parquet(Source):
    """A Parquet table; ``columns`` projects, which is also how to leave out columns of other types."""

    path: str
    columns: tuple[str, ...] | None = None

    def describe(self) -> str:
        return f"Parquet at {self.path}"

    def load(self, spark: SparkSession) -> Relation:
        return read_parquet(spark, self.path, list(self.columns) if self.columns else None)

    def version(self, spark: SparkSession) -> Version:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [system.getFileStatus(path), *system.listStatus(path)]
        return Version(tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)))
