"""Widgets that take input, and panes that turn a cell's value into a small payload."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from decimal import Decimal

from ..operators.relation import Relation
from ..types import BOOL, FLOAT, INT, TEXT, EngineError, type_of_value
from .digest import of_scalar
from .session import Failure

MAX_ROWS, MAX_CUSTOM_ROWS = 50, 500


# ---------------------------------------------------------------- widgets

@dataclass(frozen=True)
class Widget:
    kind: str  # slider, number, select, checkbox, text
    default: object
    low: float | None = None
    high: float | None = None
    step: float | None = None
    options: tuple[str, ...] = ()

    @property
    def type(self) -> str:
        return {"slider": FLOAT, "number": FLOAT, "select": TEXT, "checkbox": BOOL, "text": TEXT}[self.kind]

    def refuses(self, value: object) -> str | None:
        """Why the server does not take a value, or None."""
        kind = type_of_value(value)
        if kind != self.type and not (self.type == FLOAT and kind == INT):
            return f"it takes {self.type}, not {kind}"
        if self.type == FLOAT:
            if value != value:
                return "it takes a number"
            if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
                return f"it lies between {self.low:g} and {self.high:g}" if None not in (self.low, self.high) else "it is out of bounds"
        if self.kind == "select" and value not in self.options:
            return "its options are " + ", ".join(self.options)
        return None


# ---------------------------------------------------------------- panes

@dataclass(frozen=True)
class Pane:
    cell: str
    kind: str = "text"  # text, metric, table, bar, line, custom
    title: str = ""
    options: tuple[tuple[str, object], ...] = ()

    def option(self, name: str, default: object = None) -> object:
        return dict(self.options).get(name, default)


@dataclass(frozen=True)
class View:
    kind: str
    title: str
    data: dict

    def digest(self) -> str:
        return of_scalar(repr(sorted(asdict(self).items()))).whole


def _format_float(value: float) -> str:
    """Whole numbers without decimals, all others in full and never with an exponent."""
    if value != value:
        return "NaN"
    if value in (math.inf, -math.inf):
        return "inf" if value > 0 else "-inf"
    return f"{value:.0f}" if value == int(value) and abs(value) < 1e15 else format(Decimal(repr(value)), "f").removesuffix(".0")


def format_scalar(value: object) -> str:
    if value is None:
        return "—"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return _format_float(value)
    if isinstance(value, (list, tuple)):
        return ", ".join(format_scalar(v) for v in value)
    if isinstance(value, Relation):
        return f"{value.count()} rows × {len(value.fields)} columns"
    return str(value)


def _table(pane: Pane, value: object) -> Relation:
    if not isinstance(value, Relation):
        raise EngineError(f"pane `{pane.cell}` shows a {pane.kind}, which needs a table")
    return value


def _numbers(column: str, kind: str, values: list) -> list[float]:
    if kind not in (INT, FLOAT):
        raise EngineError(f"column `{column}` is {kind}; a chart needs numbers")
    if None in values:
        raise EngineError(f"column `{column}` is empty in row {values.index(None)}, which a chart cannot place")
    return [float(v) for v in values]


def _plotted(pane: Pane, value: object, x: str, y: str) -> tuple[list[tuple[str, str]], list[tuple]]:
    """(name, type) of the two columns of a chart, and their values in all rows."""
    rel = _table(pane, value)
    fields = [rel.field(pane.option(n)) for n in (x, y)]
    for f in fields[0 if pane.kind == "line" else 1 :]:
        _numbers(f.name, f.kind, [])
    rows = rel.df.orderBy(*rel.order).select(*(rel.df[f.at].alias(f"p{i}") for i, f in enumerate(fields))).collect()
    return [(f.name, f.kind) for f in fields], [tuple(r) for r in rows]


def render(pane: Pane, value: object) -> View:
    """The payload of a pane; only rows that are shown leave Spark."""
    if isinstance(value, Failure):
        return View("error", pane.title, {"origin": value.origin, "message": value.message})
    if pane.kind == "text":
        return View("text", pane.title, {"text": format_scalar(value)})
    if pane.kind == "metric":
        if isinstance(value, Relation):
            raise EngineError(f"pane `{pane.cell}` shows a metric, which needs a single value")
        decimals, number = pane.option("decimals"), isinstance(value, (int, float)) and not isinstance(value, bool)
        said = f"{value:.{decimals}f}" if number and decimals is not None else format_scalar(value)
        text = said if value is None else f"{pane.option('prefix', '')}{said}{pane.option('suffix', '')}"
        return View("metric", pane.title, {"label": pane.option("label", ""), "text": text})
    if pane.kind == "table":
        rel = _table(pane, value)
        return View("table", pane.title, {"columns": rel.names, "rows": rel.head(pane.option("max_rows", MAX_ROWS)), "total_rows": rel.count()})
    if pane.kind == "bar":
        ((_, _), (name, kind)), rows = _plotted(pane, value, "label_column", "value_column")
        labels, values = [format_scalar(r[0]) for r in rows], _numbers(name, kind, [r[1] for r in rows])
        return View("bar", pane.title, {"labels": labels, "values": values, "value_label": name})
    if pane.kind == "line":
        ends, rows = _plotted(pane, value, "x_column", "y_column")
        xs, ys = (_numbers(*end, [r[i] for r in rows]) for i, end in enumerate(ends))
        return View("line", pane.title, {"x": xs, "y": ys, "x_label": ends[0][0], "y_label": ends[1][0]})
    if pane.kind == "custom":
        if not isinstance(value, Relation):
            return View("custom", pane.title, {"renderer": pane.option("renderer"), "value": value})
        rel, names = value, pane.option("columns") or value.names
        at = [rel.names.index(rel.field(n).name) for n in names]
        rows = [tuple(r[i] for i in at) for r in rel.head(pane.option("max_rows", MAX_CUSTOM_ROWS))]
        return View("custom", pane.title, {"renderer": pane.option("renderer"), "columns": list(names), "rows": rows, "total_rows": rel.count()})
    raise EngineError(f"there is no pane kind `{pane.kind}`")
