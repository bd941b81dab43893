"""The table verbs, each from a relation to a relation, or to a single value.

Schemas are checked before Spark sees a plan.  Everything is declarative: filters and
projections reach the scan, joins and aggregates are left to adaptive execution.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import Node, Scope, compile_expr, parse
from ..types import BOOL, FLOAT, INT, NULL, SPARK_TYPES, TEXT, EngineError, hint, type_of_value
from .relation import Field, Relation, sort_columns

COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge", "contains")
AGGREGATES = ("count", "sum", "mean", "min", "max")
JOINS = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}


def predicate(column: Column, kind: str, op: str, value: object) -> Column:
    """One column against one value; null rows, NaN and values of another type match nothing, for ``ne`` too."""
    if op not in COMPARISONS:
        raise EngineError(f"there is no comparison `{op}`" + hint(op, list(COMPARISONS)))
    tag = type_of_value(value)
    if op == "contains":
        if kind != TEXT or tag != TEXT:
            raise EngineError(f"`contains` needs a text column and a text, not {kind} and {tag}")
        return F.contains(column, F.lit(value))
    numbers = kind in (INT, FLOAT) and tag in (INT, FLOAT)
    if tag == NULL or (kind != tag and not numbers) or value != value:
        return F.lit(False)
    either = FLOAT if FLOAT in (kind, tag) and numbers else kind
    left, right = column.cast(SPARK_TYPES[either]) if either != kind else column, F.lit(value).cast(SPARK_TYPES[either])
    test = {
        "eq": left == right, "ne": left != right, "lt": left < right, "le": left <= right, "gt": left > right,
        "ge": left >= right,
    }[op]
    return test & ~F.isnan(column) if kind == FLOAT else test


def filter_rows(rel: Relation, column: str, op: str, value: object) -> Relation:
    f = rel.field(column)
    return Relation(rel.df.where(predicate(F.col(f.at), f.kind, op, value)), rel.fields, rel.order, rel.placed)


def scope_of(rel: Relation, params: dict[str, object] | None = None) -> Scope:
    columns: dict[str, tuple[str, Column]] = {}
    for f in rel.fields:
        columns.setdefault(f.name, (f.kind, F.col(f.at)))
    return Scope(columns, params or {})


def _fresh(rel: Relation) -> str:
    taken = [int(c[1:]) for c in rel.df.columns if c[0] == "c"]
    return f"c{max(taken, default=-1) + 1}"


def derive(rel: Relation, name: str, expr: str | Node, params: dict[str, object] | None = None) -> Relation:
    """One more column, last; an existing name is an error."""
    if name in rel.names:
        raise EngineError(f"there already is a column `{name}`")
    typed = compile_expr(parse(expr) if isinstance(expr, str) else expr, scope_of(rel, params))
    at = _fresh(rel)
    return Relation(rel.df.withColumn(at, typed.column), (*rel.fields, Field(name, typed.kind, at)), rel.order, rel.placed)


def select(rel: Relation, names: list[str]) -> Relation:
    """These columns in this order; a repeated name gives repeated columns."""
    fields = tuple(rel.field(n) for n in names)
    kept = dict.fromkeys(f.at for f in fields)
    return Relation(rel.df.select(*kept, *rel.order), fields, rel.order, rel.placed)


def sort(rel: Relation, column: str, descending: bool = False) -> Relation:
    """Stable, nulls last in both directions."""
    f = rel.field(column)
    keys = sort_columns(F.col(f.at), f.kind, descending)
    df = rel.df.select(
        *(c for c in rel.df.columns if c[0] == "c"), *(k.alias(f"o{i}") for i, k in enumerate(keys)),
        *(F.col(c).alias(f"o{i + len(keys)}") for i, c in enumerate(rel.order)),
    )
    return Relation(df, rel.fields, tuple(f"o{i}" for i in range(len(keys) + len(rel.order))))


def limit(rel: Relation, n: int) -> Relation:
    """The first rows in the order as it stands here."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise EngineError("`limit` needs a number of rows")
    return Relation(rel.df.orderBy(*rel.order).limit(n), rel.fields, rel.order)


@dataclass(frozen=True)
class JoinSpec:
    left_on: tuple[str, ...]
    right_on: tuple[str, ...]
    how: str
    suffix: str = ""
    multiple: bool = False


def join_fields(left: list[tuple[str, str]], right: list[tuple[str, str]], spec: JoinSpec) -> list[tuple[str, str]]:
    """The columns a join gives; refuses what it cannot do, by name."""
    if spec.how not in JOINS:
        raise EngineError(f"there is no join `{spec.how}`" + hint(spec.how, list(JOINS)))
    if not spec.left_on or len(spec.left_on) != len(spec.right_on):
        raise EngineError("a join needs as many columns on the left as on the right, and at least one")
    kinds_l, kinds_r = dict(reversed(left)), dict(reversed(right))
    for a, b in zip(spec.left_on, spec.right_on, strict=True):
        for name, kinds, side in ((a, kinds_l, "left"), (b, kinds_r, "right")):
            if name not in kinds:
                raise EngineError(f"the {side} side of the join has no column `{name}`" + hint(name, list(kinds)))
        if kinds_l[a] != kinds_r[b]:
            raise EngineError(f"join keys must have one type: `{a}` is {kinds_l[a]} and `{b}` is {kinds_r[b]}")
    if spec.how in ("semi", "anti"):
        if spec.suffix or spec.multiple:
            raise EngineError(f"a {spec.how} join adds no columns and no rows, so it takes neither suffix nor multiple")
        return list(left)
    out = [*left, *((n + spec.suffix, k) for n, k in right if n not in spec.right_on)]
    names = [n for n, _ in out]
    if twice := next((n for n in names if names.count(n) > 1), None):
        raise EngineError(f"the join would give two columns `{twice}`; set a suffix for the right side")
    return out


def join(left: Relation, right: Relation, spec: JoinSpec) -> Relation:
    """Equi-join; null keys match nothing; left order, then right order."""
    out = join_fields(left.schema, right.schema, spec)
    keys_l, keys_r = [left.field(n).at for n in spec.left_on], [right.field(n).at for n in spec.right_on]
    if spec.how in ("inner", "left") and not spec.multiple:
        _refuse_repeats(right, keys_r, spec)
    r = right.df.select(*(F.col(c).alias(f"r_{c}") for c in right.df.columns))
    on = [F.col(a) == F.col(f"r_{b}") for a, b in zip(keys_l, keys_r, strict=True)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    df = left.df.join(r, condition, JOINS[spec.how])
    if spec.how in ("semi", "anti"):
        return Relation(df, left.fields, left.order)
    fields, columns = [], []
    sources = [(f, f.at) for f in left.fields] + [(f, f"r_{f.at}") for f in right.fields if f.name not in spec.right_on]
    for i, ((f, at), (name, kind)) in enumerate(zip(sources, out, strict=True)):
        fields.append(Field(name, kind, f"c{i}"))
        columns.append(F.col(at).alias(f"c{i}"))
    order = [*left.order, *(f"r_{c}" for c in right.order)] if spec.multiple else list(left.order)
    columns += [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    return Relation(df.select(*columns), tuple(fields), tuple(f"o{i}" for i in range(len(order))))


def _refuse_repeats(right: Relation, keys: list[str], spec: JoinSpec) -> None:
    """A join that may not widen needs unique keys on the right; this is one small aggregate job."""
    known = right.df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    again = known.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if again:
        shown = ", ".join(f"{n} = {again[0][k]!r}" for n, k in zip(spec.right_on, keys, strict=True))
        raise EngineError(
            f"the right side has {again[0]['count']} rows with {shown}, so rows would multiply; set multiple = true if they should"
        )


@dataclass(frozen=True)
class Agg:
    agg: str
    name: str
    column: str | None = None


def agg_kind(agg: str, kind: str | None, name: str) -> str:
    """The type of an aggregate over a column of ``kind``."""
    if agg not in AGGREGATES:
        raise EngineError(f"there is no aggregate `{agg}`" + hint(agg, list(AGGREGATES)))
    if agg == "count":
        return INT
    if kind is None:
        raise EngineError(f"`{agg}` needs a column")
    if kind == BOOL or (kind == TEXT and agg in ("sum", "mean")):
        raise EngineError(f"`{agg}` of `{name}` is not possible: the column is {kind}")
    return TEXT if kind == TEXT else FLOAT


def _aggregate(agg: str, column: Column | None, kind: str | None) -> Column:
    if agg == "count":
        return F.count(F.lit(1))
    if kind == TEXT:
        return F.min(column) if agg == "min" else F.max(column)
    x = column.cast("double")
    if agg == "max":  # NaN only where there is nothing else
        return F.coalesce(F.max(F.when(~F.isnan(x), x)), F.max(x))
    return {"sum": F.sum, "mean": F.avg, "min": F.min}[agg](x)


def group_fields(schema: list[tuple[str, str]], by: list[str], aggs: list[Agg]) -> list[tuple[str, str]]:
    kinds = dict(reversed(schema))
    for name in [*by, *(a.column for a in aggs if a.column is not None)]:
        if name not in kinds:
            raise EngineError(f"there is no column `{name}`" + hint(name, list(kinds)))
    out = [(n, kinds[n]) for n in by] + [(a.name, agg_kind(a.agg, kinds.get(a.column), a.column or "")) for a in aggs]
    names = [n for n, _ in out]
    if twice := next((n for n in names if names.count(n) > 1), None):
        raise EngineError(f"grouping would give two columns `{twice}`")
    return out


def group_by(rel: Relation, by: list[str], aggs: list[Agg]) -> Relation:
    """One row per key, in the order in which keys first appear; without keys one row, whatever the input."""
    out = group_fields(rel.schema, by, aggs)
    keys = [rel.field(n).at for n in by]
    columns = []
    for i, a in enumerate(aggs):
        f = rel.field(a.column) if a.column is not None and a.agg != "count" else None
        columns.append(_aggregate(a.agg, F.col(f.at) if f else None, f.kind if f else None).alias(f"a{i}"))
    single = len(rel.order) == 1
    seen = F.min(rel.order[0] if single else F.struct(*rel.order)).alias("seen")
    df = rel.df.groupBy(*keys).agg(seen, *columns) if keys else rel.df.agg(seen, *columns)
    sources = [*keys, *(f"a{i}" for i in range(len(aggs)))]
    order = [F.col("seen") if single else F.col(f"seen.{c}") for c in rel.order]
    picked = [F.col(s).cast(SPARK_TYPES[k]).alias(f"c{i}") for i, (s, (_, k)) in enumerate(zip(sources, out, strict=True))]
    df = df.select(*picked, *(c.alias(f"o{i}") for i, c in enumerate(order)))
    fields = tuple(Field(n, k, f"c{i}") for i, (n, k) in enumerate(out))
    return Relation(df, fields, tuple(f"o{i}" for i in range(len(order))))


def scalar(rel: Relation, column: str, row: int = 0) -> object:
    """One cell; a row past the end is null."""
    f = rel.field(column)
    rows = rel.df.orderBy(*rel.order).limit(row + 1).select(f.at).collect()
    return rows[row][0] if row < len(rows) else None


def count(rel: Relation) -> int:
    return rel.count()


# ---------------------------------------------------------------- steps

@dataclass(frozen=True)
class Param:
    """A value that another cell gives."""

    cell: str


@dataclass(frozen=True)
class Step:
    """One verb with its arguments; what manifests and SQL both come down to."""

    verb: str
    args: dict = field(default_factory=dict)


def _given(value: object, inputs: dict[str, object]) -> object:
    value = inputs[value.cell] if isinstance(value, Param) else value
    if isinstance(value, Relation):
        raise EngineError("a table cannot be compared with; take a scalar of it first")
    return value


def run_step(rel: Relation, step: Step, inputs: dict[str, object]) -> object:
    """Apply one step; ``inputs`` holds the values of the cells it mentions."""
    from ..types import same_value

    a = step.args
    if step.verb == "filter":
        value = _given(a["value"], inputs)
        if "skip_when" in a and same_value(value, a["skip_when"]):
            return rel
        return filter_rows(rel, a["column"], a["op"], value)
    if step.verb == "derive":
        return derive(rel, a["name"], a["expr"], {n: _given(Param(n), inputs) for n in a.get("params", ())})
    if step.verb == "join":
        other = inputs[a["with"]]
        if not isinstance(other, Relation):
            raise EngineError(f"`{a['with']}` is not a table")
        return join(rel, other, a["spec"])
    if step.verb == "select":
        return select(rel, a["names"])
    if step.verb == "sort":
        return sort(rel, a["column"], a.get("descending", False))
    if step.verb == "limit":
        return limit(rel, a["n"])
    if step.verb == "group_by":
        return group_by(rel, a["by"], a["aggs"])
    if step.verb == "scalar":
        return scalar(rel, a["column"], a.get("row", 0))
    if step.verb == "count":
        return count(rel)
    raise EngineError(f"there is no verb `{step.verb}`")


def run_steps(value: object, steps: list[Step], inputs: dict[str, object]) -> object:
    for step in steps:
        if not isinstance(value, Relation):
            raise EngineError(f"`{step.verb}` needs a table")
        value = run_step(value, step, inputs)
    return value
