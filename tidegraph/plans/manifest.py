"""An app as TOML: sources, inputs, cells and panes, checked and compiled to a graph.

Everything an author can get wrong is reported by name when the app is compiled, before
Spark runs a job for it: unknown keys, columns and cells, types that do not fit, circles.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.expr import Node, Scope, compile_expr, names_in, parse
from ..operators.relation import Relation
from ..operators.verbs import (
    COMPARISONS, Agg, JoinSpec, Param, Step, group_fields, join_fields, predicate, run_steps,
)
from ..sources.base import EmptySource, Source as DataSource
from ..sources.csv import CsvFile
from ..sources.others import HttpCsv, JdbcQuery, Parquet
from ..types import BOOL, INT, TEXT, EngineError, ExprError, hint, type_of_value
from . import sql as dialect
from .graph import Cell, Graph, Source
from .lineage import reads
from .views import Pane, Widget

MIN_REFRESH_SECS = 1
STEP_KEYS = ("filter", "derive", "join", "select", "sort", "limit", "group_by", "scalar", "count")
PANE_KINDS = {
    "text": {"": ()}, "metric": ("label", "decimals", "prefix", "suffix"), "table": ("max_rows",),
    "bar": ("label_column", "value_column"), "line": ("x_column", "y_column"), "custom": ("renderer", "columns", "max_rows"),
}


@dataclass
class App:
    title: str
    graph: Graph
    sources: dict[str, DataSource]
    refresh_secs: dict[str, int]
    widgets: dict[str, Widget]
    labels: dict[str, str]
    panes: list[Pane]
    kinds: dict[str, object] = field(default_factory=dict)


def _only(table: dict, allowed: tuple[str, ...], where: str) -> None:
    for key in table:
        if key not in allowed:
            raise EngineError(f"{where} has no setting `{key}`" + hint(key, list(allowed)))


def _need(table: dict, key: str, where: str) -> object:
    if key not in table:
        raise EngineError(f"{where} needs `{key}`")
    return table[key]


def parse_manifest(text: str) -> dict:
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as problem:
        raise EngineError(f"the manifest is not TOML: {problem}") from problem
    _only(found, ("app", "source", "input", "cell", "pane"), "the manifest")
    return found


def _source(spec: dict, folder: Path) -> DataSource:
    where = f"source `{_need(spec, 'name', 'a source')}`"
    _only(spec, ("name", "csv", "file", "http", "sql", "parquet", "columns", "refresh_secs"), where)
    given = [k for k in ("csv", "file", "http", "sql", "parquet") if k in spec]
    if len(given) != 1:
        raise EngineError(f"{where} needs exactly one of csv, file, http, sql and parquet" + (f", not {' and '.join(given)}" if given else ""))
    place = lambda p: str(p) if "://" in str(p) else str(folder / str(p))
    kind, value = given[0], spec[given[0]]
    if kind == "csv":
        return CsvFile(place(value))
    if kind == "parquet":
        return Parquet(place(value), tuple(spec["columns"]) if "columns" in spec else None)
    if kind == "file":
        _only(value, ("path", "format"), where)
        if value.get("format", "csv") != "csv":
            raise EngineError(f"{where}: only the format csv is known")
        return CsvFile(place(_need(value, "path", where)))
    if kind == "http":
        _only(value, ("url", "timeout_secs"), where)
        return HttpCsv(_need(value, "url", where), value.get("timeout_secs", 30))
    _only(value, ("dsn", "query", "watch"), where)
    dsn = _need(value, "dsn", where)
    if dsn.startswith("$"):
        if dsn[1:] not in os.environ:
            raise EngineError(f"{where}: the environment has no {dsn}")
        dsn = os.environ[dsn[1:]]
    return JdbcQuery(dsn, _need(value, "query", where), value.get("watch"))


def _widget(spec: dict) -> Widget:
    where = f"input `{_need(spec, 'name', 'an input')}`"
    kinds = ("slider", "number", "select", "checkbox", "text")
    _only(spec, ("name", "label", *kinds), where)
    given = [k for k in kinds if k in spec]
    if len(given) != 1:
        raise EngineError(f"{where} needs exactly one of {', '.join(kinds)}")
    kind, o = given[0], spec[given[0]]
    if kind in ("slider", "number"):
        _only(o, ("min", "max", "step", "default"), where)
        low, high = o.get("min"), o.get("max")
        if kind == "slider" and (low is None or high is None):
            raise EngineError(f"{where}: a slider needs min and max")
        if low is not None and high is not None and low > high:
            raise EngineError(f"{where}: min is above max")
        made = Widget(kind, float(o.get("default", low if low is not None else 0.0)), low, high, o.get("step"))
    elif kind == "select":
        _only(o, ("options", "default"), where)
        options = tuple(_need(o, "options", where))
        if not options:
            raise EngineError(f"{where} has no options")
        made = Widget(kind, o.get("default", options[0]), options=options)
    elif kind == "checkbox":
        _only(o, ("default",), where)
        made = Widget(kind, o.get("default", False))
    else:
        _only(o, ("default",), where)
        made = Widget(kind, o.get("default", ""))
    if problem := made.refuses(made.default):
        raise EngineError(f"{where}: the default does not fit; {problem}")
    return made


def _names(value: object) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


def read_step(spec: dict, where: str) -> Step | None:
    """One step of a manifest; None for ``count = false``."""
    _only(spec, STEP_KEYS, where)
    if len(spec) != 1:
        raise EngineError(f"{where}: a step is exactly one of {', '.join(STEP_KEYS)}")
    verb, a = next(iter(spec.items()))
    where = f"{where}, {verb}"
    if verb == "filter":
        _only(a, ("column", "op", "value", "param", "skip_when"), where)
        if ("value" in a) == ("param" in a):
            raise EngineError(f"{where}: compare with exactly one of value and param")
        if _need(a, "op", where) not in COMPARISONS:
            raise EngineError(f"{where}: there is no comparison `{a['op']}`" + hint(a["op"], list(COMPARISONS)))
        args = {"column": _need(a, "column", where), "op": a["op"], "value": Param(a["param"]) if "param" in a else a["value"]}
        return Step("filter", args | ({"skip_when": a["skip_when"]} if "skip_when" in a else {}))
    if verb == "derive":
        _only(a, ("name", "expr"), where)
        text = _need(a, "expr", where)
        try:
            tree = parse(text)
        except ExprError as problem:
            raise EngineError(f"{where}: {problem.with_caret(text)}") from problem
        return Step("derive", {"name": _need(a, "name", where), "expr": tree, "params": tuple(sorted(names_in(tree, "param")))})
    if verb == "join":
        _only(a, ("with", "on", "left_on", "right_on", "how", "suffix", "multiple"), where)
        if ("on" in a) == ("left_on" in a or "right_on" in a):
            raise EngineError(f"{where}: give either `on`, or `left_on` and `right_on`")
        left, right = (a["on"], a["on"]) if "on" in a else (_need(a, "left_on", where), _need(a, "right_on", where))
        spec_of = JoinSpec(_names(left), _names(right), _need(a, "how", where), a.get("suffix", ""), a.get("multiple", False))
        return Step("join", {"with": _need(a, "with", where), "spec": spec_of})
    if verb == "select":
        return Step("select", {"names": list(a)})
    if verb == "sort":
        _only(a, ("column", "descending"), where)
        return Step("sort", {"column": _need(a, "column", where), "descending": a.get("descending", False)})
    if verb == "limit":
        return Step("limit", {"n": a})
    if verb == "group_by":
        _only(a, ("by", "agg"), where)
        aggs = []
        for item in _need(a, "agg", where):
            _only(item, ("column", "agg", "as"), where)
            aggs.append(Agg(_need(item, "agg", where), _need(item, "as", where), item.get("column")))
        return Step("group_by", {"by": list(a.get("by", [])), "aggs": aggs})
    if verb == "scalar":
        _only(a, ("column", "row"), where)
        return Step("scalar", {"column": _need(a, "column", where), "row": a.get("row", 0)})
    return Step("count") if a else None


def step_schema(schema: list[tuple[str, str]], step: Step, kind_of) -> object:  # noqa: ANN001
    """The schema after a step, or the type of a value that ends the pipeline; raises what running it would."""
    a, kinds = step.args, dict(reversed(schema))

    def column(name: str) -> str:
        if name not in kinds:
            raise EngineError(f"there is no column `{name}`" + hint(name, list(kinds)))
        return kinds[name]

    def single(name: str) -> str:
        kind = kind_of(name)
        if not isinstance(kind, str):
            raise EngineError(f"`{name}` is a table; a parameter needs a single value")
        return kind

    if step.verb == "filter":
        kind = column(a["column"])
        tag = single(a["value"].cell) if isinstance(a["value"], Param) else type_of_value(a["value"])
        if a["op"] == "contains" and (kind != TEXT or tag != TEXT):
            raise EngineError(f"`contains` needs a text column and a text, not {kind} and {tag}")
        return schema
    if step.verb == "derive":
        if a["name"] in kinds:
            raise EngineError(f"there already is a column `{a['name']}`")
        return [*schema, (a["name"], _kind_of_expr(a["expr"], kinds, {p: single(p) for p in a["params"]}))]
    if step.verb == "join":
        right = kind_of(a["with"])
        if isinstance(right, str):
            raise EngineError(f"`{a['with']}` is not a table")
        return join_fields(schema, right, a["spec"])
    if step.verb == "select":
        return [(n, column(n)) for n in a["names"]]
    if step.verb == "group_by":
        return group_fields(schema, a["by"], a["aggs"])
    if step.verb == "scalar":
        return column(a["column"])
    if step.verb == "count":
        return INT
    if step.verb == "sort":
        column(a["column"])
    if step.verb == "limit" and (type(a["n"]) is not int or a["n"] < 0):
        raise EngineError("`limit` needs a number of rows")
    return schema


_SAMPLES = {"int": 1, "float": 1.0, "text": "", "bool": True, "null": None}


def _kind_of_expr(tree: Node, kinds: dict[str, str], params: dict[str, str]) -> str:
    from pyspark.sql import functions as F

    scope = Scope({n: (k, F.lit(_SAMPLES[k])) for n, k in kinds.items()}, {p: _SAMPLES[k] for p, k in params.items()})
    return compile_expr(tree, scope).kind


def _inputs(steps: list[Step]) -> list[str]:
    found = []
    for s in steps:
        if s.verb == "filter" and isinstance(s.args["value"], Param):
            found.append(s.args["value"].cell)
        found += s.args.get("params", ()) if s.verb == "derive" else [s.args["with"]] if s.verb == "join" else []
    return list(dict.fromkeys(found))


def compile_app(text: str, spark: SparkSession, folder: str = ".", data: dict[str, Relation] | None = None) -> App:
    """A manifest to an app; ``data`` stands in for sources by name, as in tests."""
    found = parse_manifest(text)
    app = found.get("app", {})
    _only(app, ("title", "subtitle"), "[app]")
    data_sources = {s["name"]: _source(s, Path(folder)) for s in found.get("source", []) if _need(s, "name", "a source")}
    refresh = {}
    for s in found.get("source", []):
        if "refresh_secs" in s:
            if s["refresh_secs"] < MIN_REFRESH_SECS:
                raise EngineError(f"source `{s['name']}`: refresh_secs is at least {MIN_REFRESH_SECS}")
            refresh[s["name"]] = s["refresh_secs"]
    widgets = {w["name"]: _widget(w) for w in found.get("input", []) if _need(w, "name", "an input")}
    kinds: dict[str, object] = {}
    sources = []
    for name, source in data_sources.items():
        rel = (data or {}).get(name) or source.load(spark)
        sources.append(Source(name, rel))
        kinds[name] = rel.schema
    for name, widget in widgets.items():
        sources.append(Source(name, widget.default, widget.type))
        kinds[name] = widget.type
    specs = {c["name"]: c for c in found.get("cell", []) if _need(c, "name", "a cell")}
    if len(specs) != len(found.get("cell", [])):
        raise EngineError("two cells share a name")

    def kind_of(name: str) -> object:
        if name in kinds:
            return kinds[name]
        if name not in specs:
            raise EngineError(f"there is no `{name}`" + hint(name, [*kinds, *specs]))
        if name in compiling:
            raise EngineError("cells depend on each other in a circle: " + ", ".join(compiling))
        compile_cell(name)
        return kinds[name]

    compiling: list[str] = []
    cells: dict[str, Cell] = {}

    def compile_cell(name: str) -> None:
        spec, where = specs[name], f"cell `{name}`"
        _only(spec, ("name", "from", "step", "sql", "place"), where)
        compiling.append(name)
        try:
            cells[name], kinds[name] = _cell(name, spec, kind_of)
        except ExprError as problem:
            said = problem.with_caret(spec["sql"]) if "sql" in spec else str(problem)
            raise EngineError(f"{where}: {said}") from problem
        except EngineError as problem:
            raise problem if str(problem).startswith(("cell `", "cells ")) else EngineError(f"{where}: {problem}") from problem
        finally:
            compiling.pop()

    for name in specs:
        if name not in cells:
            compile_cell(name)
    graph = Graph(sources, [cells[n] for n in specs])
    graph.split()
    panes = [_pane(p, kinds) for p in found.get("pane", [])]
    labels = {w["name"]: w.get("label", w["name"]) for w in found.get("input", [])}
    return App(app.get("title", ""), graph, data_sources, refresh, widgets, labels, panes, kinds)


def _cell(name: str, spec: dict, kind_of) -> tuple[Cell, object]:  # noqa: ANN001
    if ("sql" in spec) == ("from" in spec):
        raise EngineError("give either `from` with steps, or `sql`")
    if "sql" in spec:
        if "step" in spec:
            raise EngineError("`sql` takes no steps")

        def table(n: str) -> list[tuple[str, str]]:
            kind = kind_of(n)
            if isinstance(kind, str):
                raise EngineError(f"`{n}` is not a table")
            return kind

        origin, steps = dialect.lower(spec["sql"], table)
    else:
        origin = spec["from"]
        steps = [s for i, raw in enumerate(spec.get("step", []), 1) if (s := read_step(raw, f"step {i}"))]
    kind = kind_of(origin)
    for step in steps:
        if isinstance(kind, str):
            raise EngineError(f"`{step.verb}` comes after the pipeline has ended in a single value, or needs a table")
        kind = step_schema(kind, step, kind_of)
    inputs = tuple(dict.fromkeys([origin, *_inputs(steps)]))
    known = reads(origin, steps, kind_of) if isinstance(kind_of(origin), list) else {}
    place = spec.get("place", "server")
    if place not in ("server", "page"):
        raise EngineError("place is server or page")
    return Cell(name, inputs, lambda values: run_steps(values[origin], steps, values), known, place), kind


def _pane(spec: dict, kinds: dict[str, object]) -> Pane:
    where = f"a pane of `{_need(spec, 'cell', 'a pane')}`"
    _only(spec, ("cell", "title", *PANE_KINDS), where)
    if spec["cell"] not in kinds:
        raise EngineError(f"{where}: there is no `{spec['cell']}`" + hint(spec["cell"], list(kinds)))
    given = [k for k in PANE_KINDS if k in spec]
    if len(given) > 1:
        raise EngineError(f"{where}: give one of {', '.join(PANE_KINDS)}")
    kind = given[0] if given else "text"
    options = spec.get(kind) or {}
    if isinstance(options, dict):
        _only(options, tuple(PANE_KINDS[kind]), where)
    else:
        options = {}
    schema = kinds[spec["cell"]]
    if kind in ("table", "bar", "line") and isinstance(schema, str):
        raise EngineError(f"{where}: a {kind} needs a table")
    if kind == "metric" and not isinstance(schema, str):
        raise EngineError(f"{where}: a metric needs a single value")
    for key in ("label_column", "value_column", "x_column", "y_column"):
        if key in options and options[key] not in dict(schema):
            raise EngineError(f"{where}: there is no column `{options[key]}`" + hint(options[key], list(dict(schema))))
    for key in ("value_column", "x_column", "y_column"):
        if key in options and dict(schema)[options[key]] in (TEXT, BOOL):
            raise EngineError(f"{where}: column `{options[key]}` is no number")
    return Pane(spec["cell"], kind, spec.get("title", ""), tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in options.items()))


def load_app(path: str, spark: SparkSession) -> App:
    return compile_app(Path(path).read_text(encoding="utf-8"), spark, str(Path(path).parent))


__all__ = ["App", "EmptySource", "compile_app", "load_app", "parse_manifest", "predicate", "read_step"]
