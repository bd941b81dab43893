"""Scheduled re-reading of sources: version, load, schema, one commit for all that moved.

A source that fails keeps its rows and its version.  ``poll`` is one round; ``schedule``
uses a rate stream purely as a clock, so rounds run on the driver between batches.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ..operators.relation import Relation
from ..plans.app import AppSession
from ..plans.graph import Graph
from ..plans.manifest import App
from ..sources.base import Version
from ..types import EngineError


@dataclass
class Round:
    """What one round did: sources re-read, unchanged, and failed with their reason."""

    read: list[str] = field(default_factory=list)
    same: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    graph: Graph | None = None


class Refresher:
    def __init__(self, app: App, spark: SparkSession) -> None:
        self.app, self.spark, self.graph = app, spark, app.graph
        self._versions: dict[str, Version] = {}
        self._due: dict[str, float] = {}
        for name, source in app.sources.items():
            try:
                self._versions[name] = source.version(spark)
            except (EngineError, PySparkException, OSError):
                self._versions[name] = Version(known=False)
            except Exception:  # a file system error from the JVM
                self._versions[name] = Version(known=False)

    def poll(self, names: list[str] | None = None) -> Round:
        """Re-read what has a new version; sessions then ``rebase`` onto ``graph`` where it is not None."""
        done, values, versions = Round(), {}, {}
        for name in names if names is not None else list(self.app.sources):
            source = self.app.sources[name]
            try:
                version = source.version(self.spark)
                if version == self._versions[name]:
                    done.same.append(name)
                    continue
                rel = source.load(self.spark)
                old = self.graph.sources[name].value
                if rel.schema != old.schema:
                    raise EngineError(_schema_change(name, old, rel))
                rel.df.cache()
                values[name], versions[name] = rel, version
                done.read.append(name)
            except Exception as problem:  # whatever a source raises, the old rows stay
                done.failed[name] = str(problem).strip().splitlines()[0]
        self._versions.update(versions)
        if values and (graph := self.graph.with_sources(values)):
            self.graph = done.graph = graph
        return done

    def due(self, now: float | None = None) -> list[str]:
        """The sources whose interval has passed."""
        now = time.monotonic() if now is None else now
        found = [n for n, secs in self.app.refresh_secs.items() if now - self._due.get(n, float("-inf")) >= secs]
        for n in found:
            self._due[n] = now
        return found

    def schedule(self, sessions: list[AppSession], on_patch=None):  # noqa: ANN001, ANN201
        """A running streaming query that polls what is due and rebases every session."""

        def tick(_, batch: int) -> None:  # noqa: ANN001
            names = self.due()
            if not names:
                return
            done = self.poll(names)
            if done.graph is not None:
                for session in sessions:
                    patch = session.rebase(done.graph)
                    if on_patch:
                        on_patch(session, patch)

        secs = max(1, min(self.app.refresh_secs.values(), default=1))
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.foreachBatch(tick).trigger(processingTime=f"{secs} seconds").start()


def _schema_change(name: str, old: Relation, new: Relation) -> str:
    gone = [n for n, k in old.schema if (n, k) not in new.schema]
    came = [n for n, k in new.schema if (n, k) not in old.schema]
    said = "; ".join(x for x in (f"gone or retyped: {', '.join(gone)}" if gone else "", f"new or retyped: {', '.join(came)}" if came else "") if x)
    return f"source `{name}` came back with other columns ({said or 'in another order'}); its old rows stay"
