"""The expression language of ``derive``: text to a typed tree to a Spark column.

Rules that differ from SQL are compiled in, so Spark still sees plain expressions:
any null operand makes the result null (``and`` and ``or`` too), only ``coalesce`` and
``is_null`` look at nulls, arithmetic that has no result (overflow, division by zero)
is null, comparisons with NaN are null, ``/`` is always float.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, FLOAT, I64_MAX, I64_MIN, INT, NULL, SPARK_TYPES, TEXT, ExprError, hint, type_of_value

NUMBERS = (INT, FLOAT)


@dataclass(frozen=True)
class Node:
    """``kind`` is lit, col, param, not, neg, op or call."""

    kind: str
    at: int
    name: str = ""
    args: tuple[Node, ...] = ()
    value: object = None


def literal(value: object, at: int = 0) -> Node:
    return Node("lit", at, value=value)


def call(name: str, *args: Node, at: int = 0) -> Node:
    return Node("call", at, name, args)


def operator(name: str, *args: Node, at: int = 0) -> Node:
    return Node("op", at, name, args)


# ---------------------------------------------------------------- reading

_TOKEN = re.compile(
    r"(?P<space>\s+)"
    r"|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    r"|(?P<param>\$[A-Za-z_]\w*)"
    r"|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<quoted>`[^`]*`)"
    r"|(?P<text>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")"
    r"|(?P<op>==|!=|<=|>=|[-+*/%<>(),])"
)
_MISREAD = {
    "=": "`=` is not an operator here; equality is `==`",
    "!": "`!` is not an operator here; use `not` or `!=`",
    "'": "the text is not closed",
    '"': "the text is not closed",
    "`": "the column name is not closed",
    "$": "`$` must be followed by a parameter name",
}
#: Binding strength of the two-sided operators.
_BINDS = {"or": 1, "and": 2, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
_NOT, _COMPARE, _UNARY = 3, 4, 7
WORDS = {"and", "or", "not", "true", "false", "null"}


def read_number(text: str, at: int) -> int | float:
    if re.fullmatch(r"\d+", text):
        if int(text) > I64_MAX:
            raise ExprError(f"`{text}` does not fit a 64-bit integer", at)
        return int(text)
    return float(text)


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ExprError(_MISREAD.get(text[at], f"`{text[at]}` is not expected here"), at)
        kind, said = found.lastgroup, found.group()
        if kind == "number" and re.match(r"[A-Za-z_.]", text[found.end() : found.end() + 1] or " "):
            raise ExprError("a number ends in something that is no digit", found.end())
        if kind != "space":
            out.append((kind, said, at))
        at = found.end()
    return [*out, ("end", "", len(text))]


class _Reader:
    def __init__(self, text: str) -> None:
        self._tokens, self._next = tokens(text), 0

    def peek(self) -> tuple[str, str, int]:
        return self._tokens[self._next]

    def take(self) -> tuple[str, str, int]:
        self._next += 1
        return self._tokens[self._next - 1]

    def expect(self, said: str) -> None:
        kind, got, at = self.take()
        if got != said or kind == "text":
            raise ExprError(f"`{said}` is expected here" + (f", not `{got}`" if got else ""), at)

    def whole(self) -> Node:
        node = self.climb(0)
        kind, said, at = self.peek()
        if kind != "end":
            raise ExprError(f"`{said}` is not expected here", at)
        return node

    def climb(self, least: int) -> Node:
        left = self.prefix(least)
        while True:
            kind, said, at = self.peek()
            word = said.lower() if kind == "name" else said
            strength = _BINDS.get(word) if kind in ("op", "name") else None
            if strength is None or strength < max(least, 1):
                return left
            self.take()
            right = self.climb(strength + 1)
            left = operator(word, left, right, at=at)
            if strength == _COMPARE and _BINDS.get(self.peek()[1]) == _COMPARE and self.peek()[0] == "op":
                raise ExprError("comparisons do not chain; join two of them with `and`", self.peek()[2])

    def prefix(self, least: int) -> Node:
        kind, said, at = self.take()
        if kind == "name" and said.lower() == "not":
            if least > _NOT:
                raise ExprError("`not` needs parentheses here", at)
            return Node("not", at, args=(self.climb(_NOT),))
        if said == "-" and kind == "op":
            ahead = self.peek()
            if ahead[0] == "number" and ahead[1] == str(I64_MAX + 1):
                self.take()
                return literal(I64_MIN, at)
            return Node("neg", at, args=(self.climb(_UNARY),))
        return self.primary(kind, said, at)

    def primary(self, kind: str, said: str, at: int) -> Node:
        if kind == "number":
            return literal(read_number(said, at), at)
        if kind == "text":
            return literal(said[1:-1].replace(said[0] * 2, said[0]), at)
        if kind == "param":
            return Node("param", at, said[1:])
        if kind == "quoted":
            return Node("col", at, said[1:-1])
        if said == "(" and kind == "op":
            inner = self.climb(0)
            self.expect(")")
            return inner
        if kind == "name":
            if said.lower() in ("true", "false", "null"):
                return literal({"true": True, "false": False, "null": None}[said.lower()], at)
            if self.peek()[:2] == ("op", "("):
                self.take()
                args = []
                if self.peek()[:2] != ("op", ")"):
                    args.append(self.climb(0))
                    while self.peek()[:2] == ("op", ","):
                        self.take()
                        args.append(self.climb(0))
                self.expect(")")
                return call(said.lower(), *args, at=at)
            return Node("col", at, said)
        raise ExprError(f"an expression is expected here, not `{said}`" if said else "the expression ends too early", at)


def parse(text: str) -> Node:
    return _Reader(text).whole()


def names_in(node: Node, kind: str) -> set[str]:
    """The columns or parameters that an expression mentions."""
    found = {node.name} if node.kind == kind else set()
    return found.union(*(names_in(a, kind) for a in node.args))


# ---------------------------------------------------------------- typing

#: The functions and how many arguments each takes.
FUNCTIONS = {
    "abs": (1, 1), "round": (1, 1), "floor": (1, 1), "ceil": (1, 1), "min": (2, 2), "max": (2, 2),
    "lower": (1, 1), "upper": (1, 1), "trim": (1, 1), "len": (1, 1), "concat": (2, None), "contains": (2, 2),
    "coalesce": (2, None), "is_null": (1, 1), "if": (3, 3),
}


def unify(a: str, b: str) -> str | None:
    """The type that holds both, if there is one: null fits anything, int widens to float."""
    if a == NULL or a == b:
        return b
    if b == NULL:
        return a
    return FLOAT if {a, b} == set(NUMBERS) else None


@dataclass(frozen=True)
class Scope:
    """What names mean: columns as (type, Spark column) and parameters as values."""

    columns: dict[str, tuple[str, Column]]
    params: dict[str, object]


@dataclass(frozen=True)
class Typed:
    kind: str
    column: Column


def _wrong(node: Node, said: str) -> ExprError:
    return ExprError(said, node.at)


def _need(node: Node, typed: Typed, kinds: tuple[str, ...], what: str) -> None:
    if typed.kind != NULL and typed.kind not in kinds:
        raise _wrong(node, f"{what} needs {' or '.join(kinds)}, not {typed.kind}")


def _lit(value: object) -> Typed:
    kind = type_of_value(value)
    if kind is None:
        raise ExprError("a parameter in an expression must be a single value")
    if kind == NULL:
        return Typed(NULL, F.lit(None))
    return Typed(kind, F.lit(value).cast(SPARK_TYPES[kind]))


def _as(typed: Typed, kind: str) -> Column:
    return typed.column.cast(SPARK_TYPES[kind]) if typed.kind != kind and kind in SPARK_TYPES else typed.column


def _not_nan(typed: Typed) -> Column:
    return ~F.isnan(typed.column) if typed.kind == FLOAT else F.lit(True)


def build(node: Node, scope: Scope) -> Typed:
    """Type and column of a tree."""
    if node.kind == "lit":
        return _lit(node.value)
    if node.kind == "param":
        if node.name not in scope.params:
            raise _wrong(node, f"there is no parameter `{node.name}`" + hint(node.name, list(scope.params)))
        return _lit(scope.params[node.name])
    if node.kind == "col":
        if node.name not in scope.columns:
            raise _wrong(node, f"there is no column `{node.name}`" + hint(node.name, list(scope.columns)))
        return Typed(*scope.columns[node.name])
    args = [build(a, scope) for a in node.args]
    if node.kind == "not":
        _need(node, args[0], (BOOL,), "`not`")
        return Typed(BOOL, ~_as(args[0], BOOL))
    if node.kind == "neg":
        return _negate(node, args[0])
    return _operate(node, *args) if node.kind == "op" else _call(node, args)


def exact(op: str, a: Column, b: Column) -> Column:
    """The sum, difference or product of two int columns; null where it does not fit.

    What fits is told beforehand, since Spark's ``try_`` functions throw and catch an exception for every row that does
    not.  Both operands are bound to a name first: written out again at each use, they would double with every level.
    """
    zero = F.lit(0).cast("long")

    def told(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        up, down = F.greatest(y, zero), F.least(y, zero)
        if op == "+":
            return F.when((x <= I64_MAX - up) & (x >= I64_MIN - down), x + y)
        if op == "-":
            return F.when((x >= I64_MIN + up) & (x <= I64_MAX + down), x - y)
        near = F.abs(x.cast("double") * y.cast("double"))  # to 15 digits; decimals decide close to the limit
        wide = x.cast("decimal(19,0)") * y.cast("decimal(19,0)")
        return F.when(near < 9.2e18, x * y).when((near < 9.3e18) & wide.between(I64_MIN, I64_MAX), wide.cast("long"))

    return F.transform(F.array(F.struct(a.alias("x"), b.alias("y"))), told)[0]


def _negate(node: Node, x: Typed) -> Typed:
    _need(node, x, NUMBERS, "`-`")
    if x.kind == FLOAT:
        return Typed(FLOAT, -x.column)
    return Typed(x.kind, exact("-", F.lit(0).cast("long"), _as(x, INT)) if x.kind == INT else x.column)


def _operate(node: Node, a: Typed, b: Typed) -> Typed:
    op = node.name
    if op in ("and", "or"):
        for x in (a, b):
            _need(node, x, (BOOL,), f"`{op}`")
        left, right = _as(a, BOOL), _as(b, BOOL)
        both = left & right if op == "and" else left | right
        return Typed(BOOL, F.when(left.isNotNull() & right.isNotNull(), both))
    if op in ("==", "!=", "<", "<=", ">", ">="):
        return Typed(BOOL, _compare(node, a, b))
    for x in (a, b):
        _need(node, x, NUMBERS, f"`{op}`")
    kind = unify(a.kind, b.kind)
    if op == "/":
        return Typed(FLOAT, F.try_divide(_as(a, FLOAT), _as(b, FLOAT)))
    if kind == NULL:
        return Typed(NULL, F.lit(None))
    left, right = _as(a, kind), _as(b, kind)
    if op == "%":
        result = F.try_mod(left, right)
        if kind == INT:
            result = F.when((left == I64_MIN) & (right == -1), None).otherwise(result)
        return Typed(kind, result)
    if kind == FLOAT:
        return Typed(kind, {"+": left + right, "-": left - right, "*": left * right}[op])
    return Typed(kind, exact(op, left, right))


def _compare(node: Node, a: Typed, b: Typed) -> Column:
    kind = unify(a.kind, b.kind)
    if kind is None:
        raise _wrong(node, f"{a.kind} and {b.kind} cannot be compared")
    if kind == NULL:
        return F.lit(None).cast("boolean")
    x, y = _as(a, kind), _as(b, kind)
    result = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[node.name]
    if kind != FLOAT:
        return result
    return F.when(_not_nan(a) & _not_nan(b), result)


def _whole(x: Column, how) -> Column:  # noqa: ANN001
    """floor or ceil that leaves alone what has no fraction or no integer."""
    return F.when(F.abs(x) < float(1 << 53), how(x).cast("double")).otherwise(x)


def _call(node: Node, args: list[Typed]) -> Typed:
    name = node.name
    if name not in FUNCTIONS:
        raise _wrong(node, f"there is no function `{name}`" + hint(name, list(FUNCTIONS)))
    low, high = FUNCTIONS[name]
    if len(args) < low or (high is not None and len(args) > high):
        counts = f"{low}" if low == high else f"at least {low}"
        raise _wrong(node, f"`{name}` takes {counts} argument{'s' * (low != 1)}, not {len(args)}")
    for arg, x in zip(node.args, args, strict=True):
        if name in ("abs", "round", "floor", "ceil", "min", "max"):
            _need(arg, x, NUMBERS, f"`{name}`")
        elif name in ("lower", "upper", "trim", "len", "concat", "contains"):
            _need(arg, x, (TEXT,), f"`{name}`")
    texts = [_as(x, TEXT) for x in args]
    first = args[0]
    if name == "abs":
        if first.kind != INT:
            return Typed(first.kind, F.abs(first.column) if first.kind == FLOAT else first.column)
        return Typed(INT, F.when(first.column != I64_MIN, F.abs(F.when(first.column != I64_MIN, first.column))))
    if name in ("round", "floor", "ceil"):
        x = _as(first, FLOAT)
        return Typed(FLOAT, _whole(x, {"round": F.round, "floor": F.floor, "ceil": F.ceil}[name]))
    if name in ("min", "max"):
        return _pick(node, *args)
    if name in ("lower", "upper", "trim"):
        trimmed = lambda s: F.regexp_replace(s, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
        return Typed(TEXT, {"lower": F.lower, "upper": F.upper, "trim": trimmed}[name](texts[0]))
    if name == "len":
        return Typed(INT, F.char_length(texts[0]).cast("long"))
    if name == "concat":
        return Typed(TEXT, F.concat(*texts))
    if name == "contains":
        return Typed(BOOL, F.contains(*texts))
    if name == "is_null":
        return Typed(BOOL, first.column.isNull())
    parts = args[1:] if name == "if" else args
    kind = parts[0].kind
    for arg, x in zip(node.args[-len(parts) :], parts, strict=True):
        kind = unify(kind, x.kind) or kind
        if unify(kind, x.kind) is None:
            raise _wrong(arg, f"the branches of `{name}` do not fit: {parts[0].kind} and {x.kind}")
    if name == "coalesce":
        return Typed(kind, F.coalesce(*(_as(x, kind) for x in parts)))
    _need(node.args[0], first, (BOOL,), "the condition of `if`")
    condition = _as(first, BOOL)
    return Typed(kind, F.when(condition, _as(parts[0], kind)).when(~condition, _as(parts[1], kind)))


def _pick(node: Node, a: Typed, b: Typed) -> Typed:
    """min or max of two, where null and NaN win and a tie keeps the first."""
    kind = unify(a.kind, b.kind)
    if kind == NULL:
        return Typed(NULL, F.lit(None))
    x, y = _as(a, kind), _as(b, kind)
    first = x <= y if node.name == "min" else x >= y
    known = x.isNotNull() & y.isNotNull() & _not_nan(Typed(kind, x)) & _not_nan(Typed(kind, y))
    return Typed(kind, F.when(known, F.when(first, x).otherwise(y)))


def compile_expr(node: Node, scope: Scope) -> Typed:
    """Like ``build``, but an expression that can only be null is refused."""
    typed = build(node, scope)
    if typed.kind == NULL:
        raise ExprError("the expression is always null, so it has no type", node.at)
    return Typed(typed.kind, typed.column.cast(SPARK_TYPES[typed.kind]))
