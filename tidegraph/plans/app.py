"""A viewer of an app: set inputs, get patches, resume, explain; plus the app as text."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..functions.expr import exact
from ..operators.relation import Relation
from ..types import EngineError, hint
from .graph import Graph
from .manifest import App
from .session import Session, Trace
from .views import View, render

MAX_RESUME_BYTES = 4096


@dataclass(frozen=True)
class Patch:
    """What a pass changed on the page, and what it cost."""

    panes: dict[int, View]
    stats: dict[str, int]
    epoch: int


@dataclass(frozen=True)
class Rejected:
    reasons: dict[str, str]


@dataclass
class Resumed:
    applied: list[str] = field(default_factory=list)
    dropped: dict[str, str] = field(default_factory=dict)


class AppSession:
    def __init__(self, app: App, resume: str | None = None) -> None:
        self.app = app
        self.core = Session(app.graph)
        self.resumed = self._resume(resume) if resume else Resumed()
        self.core.commit(run=False)
        self.trace = self.core.refresh()
        self._shown: dict[int, str] = {}
        self.views = self._render(range(len(app.panes)))

    # -- state that a client may keep
    def state(self) -> str:
        """What this viewer has set, as JSON; too much of it is an error, not a truncation."""
        text = json.dumps({n: self.core.value(n) for n in self.app.widgets if n in self.core._own}, ensure_ascii=False)
        if len(text.encode()) > MAX_RESUME_BYTES:
            raise EngineError(f"the state is larger than {MAX_RESUME_BYTES} bytes")
        return text

    def _resume(self, text: str) -> Resumed:
        done = Resumed()
        if len(text.encode()) > MAX_RESUME_BYTES:
            return Resumed(dropped={"": f"the state is larger than {MAX_RESUME_BYTES} bytes"})
        try:
            found = json.loads(text)
        except ValueError:
            return Resumed(dropped={"": "the state is not JSON"})
        if not isinstance(found, dict):
            return Resumed(dropped={"": "the state is not an object"})
        for name, value in found.items():
            if problem := self._refuses(name, value):
                done.dropped[name] = problem
            else:
                self.core.set(name, value)
                done.applied.append(name)
        return done

    def _refuses(self, name: str, value: object) -> str | None:
        widget = self.app.widgets.get(name)
        if widget is None:
            return f"there is no input `{name}`" + hint(name, list(self.app.widgets))
        return widget.refuses(value) or self.core.can_set(name, value)

    # -- passes
    def set(self, values: dict[str, object]) -> Patch | Rejected:
        """All of ``values`` or none."""
        reasons = {n: p for n, v in values.items() if (p := self._refuses(n, v))}
        if reasons:
            return Rejected(reasons)
        for name, value in values.items():
            self.core.set(name, value)
        return self._patch(self.core.commit())

    def refresh(self) -> Patch:
        return self._patch(self.core.refresh())

    def rebase(self, graph: Graph) -> Patch:
        return self._patch(self.core.rebase(graph))

    def _render(self, panes) -> dict[int, View]:  # noqa: ANN001
        out = {}
        for i in panes:
            pane = self.app.panes[i]
            try:
                view = render(pane, self.core.value(pane.cell))
            except EngineError as problem:
                view = View("error", pane.title, {"origin": pane.cell, "message": str(problem)})
            if self._shown.get(i) != (digest := view.digest()):
                self._shown[i] = digest
                out[i] = view
        return out

    def _patch(self, trace: Trace) -> Patch:
        self.trace = trace
        moved = set(trace.changed)
        changed = self._render(i for i, p in enumerate(self.app.panes) if p.cell in moved)
        self.views = self.views | changed
        return Patch(changed, trace.summary() | {"panes": len(changed)}, trace.epoch)


def nudged(rel: Relation, column: str) -> Relation:
    """The table with one column changed everywhere: +1, +1.0, negated, or a star behind it."""
    from pyspark.sql import functions as F

    f = rel.field(column)
    c = F.col(f.at)
    new = {"int": exact("+", c, F.lit(1).cast("long")), "float": c + 1.0, "bool": ~c, "text": F.concat(c, F.lit("*"))}[f.kind]
    return Relation(rel.df.withColumn(f.at, new), rel.fields, rel.order, rel.placed)


def explain(app: App, sets: dict[str, object] | None = None, change_column: tuple[str, str] | None = None) -> str:
    """First render, and then the pass that an interaction or a changed source column causes."""
    viewer = AppSession(app)
    out = ["first render", _said(viewer.trace, len(viewer.views))]
    if sets:
        done = viewer.set(sets)
        if isinstance(done, Rejected):
            raise EngineError("; ".join(f"{n}: {p}" for n, p in done.reasons.items()))
        out += ["", "set " + ", ".join(f"{n} = {v!r}" for n, v in sets.items()), _said(viewer.trace, len(done.panes))]
    if change_column:
        source, column = change_column
        rel = viewer.core.value(source)
        if not isinstance(rel, Relation):
            raise EngineError(f"`{source}` is not a table")
        graph = viewer.core.graph.with_sources({source: nudged(rel, column)})
        panes = len(viewer.rebase(graph).panes) if graph else 0
        out += ["", f"change {source}.{column}", _said(viewer.trace, panes) if graph else "nothing changed"]
    return "\n".join(out)


def _said(trace: Trace, panes: int) -> str:
    s = trace.summary()
    lines = [f"  {x.outcome:<9} {x.cell}" + ("  (changed)" if x.changed else "") for x in trace.steps]
    return "\n".join([*lines, "  " + ", ".join(f"{k} {v}" for k, v in s.items()) + f", panes {panes}"])


def check(app: App) -> str:
    """What an app is made of, in one line."""
    return f"{app.title or 'app'}: {len(app.sources)} sources, {len(app.widgets)} inputs, {len(app.graph.cells)} cells, {len(app.panes)} panes"


def graph_text(app: App, form: str = "text") -> str:
    """The graph as text, mermaid or JSON."""
    g = app.graph
    if form == "text":
        return "\n".join([*(f"{n}" for n in g.sources), *(f"{'  ' * g.height[n]}{n} <- {', '.join(g.cells[n].inputs)}" for n in g.order)])
    if form == "mermaid":
        ids = {n: f"n{i}" for i, n in enumerate([*g.sources, *g.order])}
        nodes = [f'  {ids[n]}[("{n}")]' for n in g.sources] + [f'  {ids[n]}["{n}"]' for n in g.order]
        return "\n".join(["graph LR", *nodes, *(f"  {ids[i]} --> {ids[n]}" for n in g.order for i in g.cells[n].inputs)])
    if form == "json":
        cells = [{"name": n, "inputs": list(g.cells[n].inputs), "height": g.height[n]} for n in g.order]
        return json.dumps({"sources": list(g.sources), "cells": cells, "panes": [p.cell for p in app.panes]}, indent=2)
    raise EngineError(f"there is no form `{form}`" + hint(form, ["text", "mermaid", "json"]))
