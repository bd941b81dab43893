"""What a pipeline reads of its inputs, from its steps and their schemas alone.

Every column is followed from the inputs through derives, selections, joins and groups;
beside them go the columns that decide which rows there are.  A cell may be reused although
an input changed, if no column that it reads moved and the rows it picks are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..functions.expr import Node, names_in, parse
from ..operators.verbs import Step

Origins = frozenset[tuple[str, str]]  # (input, column)


@dataclass(frozen=True)
class Reads:
    """Columns of an input whose values matter, and leading steps that only pick or order its rows."""

    columns: frozenset[str]
    constraints: tuple[Step, ...] = ()


class _Trail:
    """Where the columns of the table at hand come from, and what decided its rows."""

    def __init__(self, origin: str, schema: list[tuple[str, str]]) -> None:
        self.origin = origin
        self.columns: dict[str, Origins] = {n: frozenset([(origin, n)]) for n, _ in schema}
        self.rows: set[tuple[str, str]] = set()
        self.constraints: list[Step] = []
        self.leading = True

    def of(self, *names: str) -> set[tuple[str, str]]:
        return {o for n in names for o in self.columns.get(n, ())}

    def pick(self, step: Step) -> None:
        column = step.args["column"]
        if self.leading and self.columns.get(column) == frozenset([(self.origin, column)]):
            self.constraints.append(step)  # the column counts only for which rows come, and in which order
        else:
            self.rows |= self.of(column)

    def derive(self, step: Step) -> None:
        tree = step.args["expr"]
        tree = tree if isinstance(tree, Node) else parse(tree)
        self.columns[step.args["name"]] = frozenset(self.of(*names_in(tree, "col")))

    def join(self, step: Step, schema: list[tuple[str, str]]) -> None:
        other, spec = step.args["with"], step.args["spec"]
        self.rows |= self.of(*spec.left_on) | {(other, n) for n in spec.right_on}
        if spec.how in ("inner", "left"):
            self.columns |= {n + spec.suffix: frozenset([(other, n)]) for n, _ in schema if n not in spec.right_on}

    def group(self, step: Step) -> None:
        by, aggs = step.args["by"], step.args["aggs"]
        self.rows |= self.of(*by)
        made = {a.name: frozenset(self.of(a.column) if a.column is not None and a.agg != "count" else ()) for a in aggs}
        self.columns = {n: self.columns[n] for n in by} | made


def reads(origin: str, steps: list[Step], schema_of: Callable[[str], list[tuple[str, str]]]) -> dict[str, Reads]:
    """What is read of each input table; one that is read under two roles is left out, which means all of it."""
    trail, others = _Trail(origin, schema_of(origin)), []
    for step in steps:
        if step.verb in ("filter", "sort"):
            trail.pick(step)
        elif step.verb == "derive":
            trail.derive(step)
        elif step.verb == "select":
            trail.columns = {n: trail.columns[n] for n in step.args["names"]}
        else:
            trail.leading = False
            if step.verb == "join":
                others.append(step.args["with"])
                trail.join(step, schema_of(step.args["with"]))
            elif step.verb == "group_by":
                trail.group(step)
            elif step.verb == "scalar":
                trail.columns = {step.args["column"]: trail.columns[step.args["column"]]}
            elif step.verb == "count":
                trail.columns = {}
    needed = trail.rows.union(*trail.columns.values())
    once = [n for n in (origin, *others) if [origin, *others].count(n) == 1]
    return {
        n: Reads(frozenset(c for at, c in needed if at == n), tuple(trail.constraints) if n == origin else ())
        for n in once
    }
