"""One viewer's state over a shared graph: stage values, commit, and recompute only what moved.

A commit digests what was staged, walks the cells downstream of real changes in order of
height, reuses every cell whose inputs look the same in all it reads of them, and records
each decision in a trace.  Errors are values: a failing cell fails its readers, naming
the cell where it began, and recovers when its inputs do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException

from ..operators.relation import Field, Relation
from ..operators.verbs import Param, run_step
from ..types import FLOAT, INT, NULL, EngineError, hint, type_of_value
from .cache import CacheLedger
from .digest import Digest, of_scalar, of_value
from .graph import Graph
from .lineage import Reads


#: What the tables of one viewer may take in memory unless a ledger says otherwise.
CACHE_BYTES = 1 << 30


@dataclass(frozen=True)
class Failure:
    """An error as a value; ``origin`` is the cell it began in."""

    origin: str
    message: str


@dataclass
class Slot:
    value: object
    digest: Digest
    keys: tuple = ()


@dataclass(frozen=True)
class TraceStep:
    cell: str
    outcome: str  # set, evaluated, reused, failed
    changed: bool


@dataclass
class Trace:
    epoch: int
    roots: tuple[str, ...]
    steps: list[TraceStep] = field(default_factory=list)
    total: int = 0

    def _count(self, outcome: str) -> int:
        return sum(s.outcome == outcome for s in self.steps)

    @property
    def visited(self) -> int:
        """Sources that were set, and cells that were looked at."""
        return len(self.steps)

    @property
    def evaluated(self) -> int:
        return self._count("evaluated") + self._count("failed")

    @property
    def reused(self) -> int:
        return self._count("reused")

    @property
    def changed(self) -> list[str]:
        return [s.cell for s in self.steps if s.changed]

    def summary(self) -> dict[str, int]:
        moved = sum(s.changed and s.outcome != "set" for s in self.steps)
        return {
            "visited": self.visited, "evaluated": self.evaluated, "reused": self.reused, "changed": moved,
            "untouched": self.total - self.visited,
        }


def accepts(declared: str | None, kind: str | None) -> bool:
    """Whether a value of ``kind`` may be set on a source declared so; an int may stand for a float."""
    return declared in (None, NULL) or kind == declared or (declared == FLOAT and kind == INT)


class Session:
    """``ledger`` bounds what this viewer's tables may keep in memory; viewers may share one."""

    def __init__(self, graph: Graph, ledger: CacheLedger | None = None) -> None:
        self.graph = graph
        self.epoch = 0
        self.slots: dict[str, Slot] = {n: Slot(s.value, s.digest) for n, s in graph.sources.items()}
        self._staged: dict[str, object] = {}
        self._own: set[str] = set()  # sources this viewer has set
        self._changed_at: dict[str, int] = {}
        self._row_digests: dict[tuple, tuple[tuple, str]] = {}
        self.ledger = ledger or CacheLedger(CACHE_BYTES)

    # -- staging
    def can_set(self, name: str, value: object) -> str | None:
        """Why a value may not be set, or None."""
        source = self.graph.sources.get(name)
        if source is None:
            if name in self.graph.cells:
                return f"`{name}` is computed and cannot be set"
            return f"there is no input `{name}`" + hint(name, list(self.graph.sources))
        if isinstance(source.value, Relation):
            return None if isinstance(value, Relation) and value.schema == source.value.schema else f"`{name}` holds a table of other columns"
        declared = source.kind or type_of_value(source.value)
        if not accepts(declared, type_of_value(value)):
            return f"`{name}` takes {declared}, not {type_of_value(value) or type(value).__name__}"
        return None

    def set(self, name: str, value: object) -> None:
        """Stage a value; the last one before a commit wins."""
        if problem := self.can_set(name, value):
            raise EngineError(problem)
        self._staged[name] = value

    # -- passes
    def commit(self, run: bool = True) -> Trace:
        """Apply what is staged and recompute what it reaches, or leave that to a refresh."""
        staged, self._staged = self._staged, {}
        self.epoch += 1
        trace = Trace(self.epoch, tuple(staged), total=len(self.graph.cells) + len(self.graph.sources))
        moved = set()
        for name, value in staged.items():
            digest = of_value(value)
            changed = digest != self.slots[name].digest
            self._own.add(name)
            trace.steps.append(TraceStep(name, "set", changed))
            if changed:
                self.slots[name] = Slot(value, digest)
                self._changed_at[name] = self.epoch
                moved.add(name)
        self._run(self.graph.downstream(moved) if moved and run else [], trace)
        return trace

    def refresh(self) -> Trace:
        """Visit every cell; what did not move is still reused."""
        self.epoch += 1
        trace = Trace(self.epoch, (), total=len(self.graph.cells) + len(self.graph.sources))
        self._run(self.graph.order, trace)
        return trace

    def rebase(self, graph: Graph) -> Trace:
        """Move to a graph with other source values; what this viewer has set stays set."""
        self.epoch += 1
        self.graph = graph
        trace = Trace(self.epoch, (), total=len(graph.cells) + len(graph.sources))
        moved = set()
        for name, source in graph.sources.items():
            if name in self._own or self.slots[name].digest == source.digest:
                continue
            self.slots[name] = Slot(source.value, source.digest)
            self._changed_at[name] = self.epoch
            trace.steps.append(TraceStep(name, "set", True))
            moved.add(name)
        trace.roots = tuple(moved)
        self._run(graph.downstream(moved) if moved else [], trace)
        return trace

    def changed_since(self, epoch: int) -> list[str]:
        return [n for n, at in self._changed_at.items() if at > epoch]

    def frontier(self, since: int = -1) -> dict[str, object]:
        """The values that a page needs from the server and that have changed after an epoch."""
        return {n: self.value(n) for n in self.graph.frontier() if self._changed_at.get(n, 0) > since}

    def value(self, name: str) -> object:
        if name not in self.slots:
            raise EngineError(f"there is no value `{name}`" + hint(name, list(self.slots)))
        return self.slots[name].value

    # -- evaluation
    def _run(self, cells: list[str], trace: Trace) -> None:
        for name in cells:
            cell, before = self.graph.cells[name], self.slots.get(name)
            keys = tuple(self._key(i, cell.reads.get(i)) for i in dict.fromkeys(cell.inputs))
            if before is not None and before.keys == keys and not isinstance(before.value, Failure):
                trace.steps.append(TraceStep(name, "reused", False))
                continue
            value = self._evaluate(name)
            failed = isinstance(value, Failure)
            try:
                digest = of_scalar(f"{value.origin}: {value.message}") if failed else of_value(value)
            except (EngineError, PySparkException) as problem:  # a table may fail only when it is read
                value, failed = Failure(name, _said(problem)), True
                digest = of_scalar(f"{value.origin}: {value.message}")
            changed = before is None or before.digest != digest
            if changed:
                self.ledger.drop((id(self), name))
                self.slots[name] = Slot(value, digest, keys)
                self._changed_at[name] = self.epoch
                if isinstance(value, Relation):
                    self.ledger.hold((id(self), name), value.df)
            else:
                before.keys = keys
                self.ledger.touch((id(self), name))
                if isinstance(value, Relation) and value.df is not before.value.df:
                    value.df.unpersist()
            trace.steps.append(TraceStep(name, "failed" if failed else "evaluated", changed))

    def _evaluate(self, name: str) -> object:
        cell = self.graph.cells[name]
        inputs = {i: self.slots[i].value for i in cell.inputs}
        if broken := next((v for v in inputs.values() if isinstance(v, Failure)), None):
            return broken
        try:
            value = cell.compute(inputs)
            if isinstance(value, Relation):
                value.df.cache()  # its digest and every reader read it
            return value
        except (EngineError, PySparkException) as problem:
            return Failure(name, _said(problem))
        except Exception as problem:  # an author's own function
            return Failure(name, f"{type(problem).__name__}: {problem}")

    # -- what a cell sees of an input
    def _key(self, name: str, reads: Reads | None) -> tuple:
        slot = self.slots[name]
        if reads is None or not isinstance(slot.value, Relation):
            return (slot.digest.whole,)
        missing = [c for c in reads.columns if not slot.digest.column(c)]
        if missing:
            return (slot.digest.whole,)
        picked = self._rows_key(name, slot, reads)
        if picked is None:
            return (slot.digest.whole,)
        return (slot.digest.shape, *((c, slot.digest.column(c)) for c in sorted(reads.columns)), picked)

    def _rows_key(self, name: str, slot: Slot, reads: Reads) -> str | None:
        """What tells which rows the leading filters and sorts pick, and in which order.

        Rows that lie in a source are named by their places, so moved values that pick the same rows do not count.
        Of other tables the columns that the steps look at count, and the values that they compare with.
        """
        if not reads.constraints:
            return ""
        params = {s.args["value"].cell for s in reads.constraints if s.verb == "filter" and isinstance(s.args["value"], Param)}
        values = tuple((p, self.slots[p].digest.whole) for p in sorted(params))
        columns = tuple(slot.digest.column(s.args["column"]) for s in reads.constraints)
        key = (slot.digest.shape, columns, values)
        if not slot.value.placed:
            return repr(key)
        at = (name, repr(reads.constraints))
        if self._row_digests.get(at, ("",))[0] != key:  # only the last answer is kept
            inputs = {p: self.slots[p].value for p in params}
            if any(isinstance(v, (Failure, Relation)) for v in inputs.values()):
                return None
            try:
                self._row_digests[at] = (key, self._rows_digest(slot.value, reads, inputs))
            except (EngineError, PySparkException):
                return None
        return self._row_digests[at][1]

    @staticmethod
    def _rows_digest(rel: Relation, reads: Reads, inputs: dict[str, object]) -> str:
        from pyspark.sql import functions as F

        picked = Relation(rel.df.withColumn("c_row", F.xxhash64(*rel.order)), rel.fields, rel.order, rel.placed)
        for step in reads.constraints:
            picked = run_step(picked, step, inputs)
        return of_value(Relation(picked.df, (Field("row", INT, "c_row"),), picked.order, picked.placed)).whole


def _said(problem: Exception) -> str:
    return str(problem).strip().splitlines()[0]
