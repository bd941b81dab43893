"""A closed SQL dialect: one ``select`` statement, lowered to the same steps as a manifest's.

It is never handed to ``spark.sql``: nulls follow the expression language, so ``or``,
``in``, ``not`` and ``case`` are null where an operand is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..functions.expr import FUNCTIONS, Node, call, literal, names_in, operator, read_number
from ..operators.verbs import Agg, JoinSpec, Param, Step
from ..types import I64_MAX, I64_MIN, ExprError, hint

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)"
    r"|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    r"|(?P<param>:[A-Za-z_]\w*)"
    r"|(?P<word>[A-Za-z_]\w*)"
    r"|(?P<quoted>\"(?:[^\"]|\"\")*\"|`[^`]*`)"
    r"|(?P<text>'(?:[^']|'')*')"
    r"|(?P<op><>|!=|<=|>=|\|\||::|[-+*/%<>=(),.;])",
    re.S,
)
#: Words that a statement may not use, and what to do instead.
REFUSED = {
    "with": "common table expressions are not supported; make the inner query a cell of its own",
    "union": "`union` is not supported; a cell has one input table and at most one join",
    "intersect": "`intersect` is not supported; use a semi join",
    "except": "`except` is not supported; use an anti join",
    "having": "`having` is not supported; filter in a second cell that reads this one",
    "distinct": "`distinct` is not supported; group by the columns instead",
    "offset": "`offset` is not supported; only `limit` is",
    "fetch": "`fetch` is not supported; use `limit`",
    "over": "window functions are not supported",
    "window": "window functions are not supported",
    "partition": "window functions are not supported",
    "cast": "`cast` is not supported; a column's type is that of its source",
    "like": "`like` is not supported; use contains(column, 'text')",
    "ilike": "`ilike` is not supported; use contains(lower(column), 'text')",
    "similar": "`similar to` is not supported; use contains(column, 'text')",
    "exists": "`exists` is not supported; use a semi join",
    "any": "`any` is not supported; use a semi join",
    "all": "`all` is not supported; use a semi join",
    "right": "`right join` is not supported; swap the tables and use a left join",
    "full": "`full join` is not supported",
    "cross": "`cross join` is not supported",
    "natural": "`natural join` is not supported; name the keys with `on`",
    "using": "`using` is not supported; write `on a.key = b.key`",
    "lateral": "`lateral` is not supported",
    "values": "`values` is not supported; the rows have to come from a source",
    "interval": "there are no dates here, so no `interval`",
    "extract": "there are no dates here, so no `extract`",
    "insert": "only `select` is supported",
    "update": "only `select` is supported",
    "delete": "only `select` is supported",
    "create": "only `select` is supported",
    "drop": "only `select` is supported",
    "alter": "only `select` is supported",
    "rollup": "`rollup` is not supported",
    "cube": "`cube` is not supported",
    "grouping": "`grouping sets` is not supported",
}
_KEYWORDS = set(
    "select from where group by order limit as join inner left outer semi anti on and or not in is between case when then "
    "else end asc desc null true false".split()
)
AGGREGATE_NAMES = {"sum": "sum", "avg": "mean", "count": "count", "min": "min", "max": "max"}


@dataclass(frozen=True)
class Item:
    expr: Node | None  # None: *
    name: str | None
    at: int


@dataclass(frozen=True)
class Join:
    table: str
    alias: str
    how: str
    on: tuple[tuple[Node, Node], ...]


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    alias: str
    join: Join | None
    where: Node | None
    group: tuple[Node, ...] | None
    order: tuple[Node, bool] | None
    limit: int | None


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ExprError(f"`{text[at]}` is not expected here", at)
        if found.lastgroup != "space":
            out.append((found.lastgroup, found.group(), at))
        at = found.end()
    return [*out, ("end", "", len(text))]


class _Parser:
    def __init__(self, text: str) -> None:
        self._tokens, self._next = _tokens(text), 0

    # -- moving over tokens
    def at(self) -> int:
        return self._tokens[self._next][2]

    def word(self, ahead: int = 0) -> str:
        kind, said, _ = self._tokens[min(self._next + ahead, len(self._tokens) - 1)]
        return said.lower() if kind == "word" else ""

    def sign(self) -> str:
        kind, said, _ = self._tokens[self._next]
        return said if kind == "op" else ""

    def step(self) -> tuple[str, str, int]:
        self._next += 1
        return self._tokens[self._next - 1]

    def accept(self, *said: str) -> bool:
        for i, w in enumerate(said):
            kind, got, _ = self._tokens[min(self._next + i, len(self._tokens) - 1)]
            if kind not in ("word", "op") or got.lower() != w:
                return False
        self._next += len(said)
        return True

    def need(self, said: str) -> None:
        if not self.accept(said):
            self.refuse()
            got = self._tokens[self._next][1]
            raise ExprError(f"`{said}` is expected here" + (f", not `{got}`" if got else ""), self.at())

    def refuse(self) -> None:
        if (word := self.word()) in REFUSED:
            raise ExprError(REFUSED[word], self.at())

    def name(self, what: str) -> str:
        self.refuse()
        kind, said, at = self.step()
        if kind == "quoted":
            return said[1:-1].replace(said[0] * 2, said[0])
        if kind == "word" and said.lower() not in _KEYWORDS:
            return said
        if said == "(":
            raise ExprError("a subquery is not supported; make it a cell of its own", at)
        raise ExprError(f"{what} is expected here" + (f", not `{said}`" if said else ""), at)

    # -- the statement
    def statement(self) -> Select:
        self.refuse()
        self.need("select")
        items = [self.item()]
        while self.accept(","):
            items.append(self.item())
        self.need("from")
        table = self.name("a table")
        alias = self.alias() or table
        join = self.join()
        if self.sign() == ",":
            raise ExprError("a second table needs a `join`", self.at())
        self.refuse()
        where = self.expr() if self.accept("where") else None
        group = None
        if self.accept("group", "by"):
            group = [self.column()]
            while self.accept(","):
                group.append(self.column())
        self.refuse()
        order = None
        if self.accept("order", "by"):
            key = self.column()
            down = self.accept("desc")
            if not down:
                self.accept("asc")
            if self.sign() == ",":
                raise ExprError("only one sort column is supported", self.at())
            if self.word() == "nulls":
                raise ExprError("nulls always sort last", self.at())
            order = (key, down)
        self.refuse()
        limit = None
        if self.accept("limit"):
            kind, said, at = self.step()
            if kind != "number" or not said.isdigit():
                raise ExprError("`limit` needs a whole number", at)
            limit = int(said)
        self.refuse()
        self.accept(";")
        if self._tokens[self._next][0] != "end":
            raise ExprError(f"`{self._tokens[self._next][1]}` is not expected here", self.at())
        return Select(tuple(items), table, alias, join, where, tuple(group) if group else None, order, limit)

    def alias(self) -> str | None:
        if self.accept("as"):
            return self.name("a name")
        kind, said, _ = self._tokens[self._next]
        if kind == "quoted" or (kind == "word" and said.lower() not in _KEYWORDS and said.lower() not in REFUSED):
            return self.name("a name")
        return None

    def item(self) -> Item:
        at = self.at()
        self.refuse()
        if self.accept("*"):
            return Item(None, None, at)
        expr = self.expr()
        return Item(expr, self.alias(), at)

    def join(self) -> Join | None:
        found = None
        while True:
            self.refuse()
            if self.accept("join") or self.accept("inner", "join"):
                how = "inner"
            elif self.accept("left", "join") or self.accept("left", "outer", "join"):
                how = "left"
            elif self.accept("left", "semi", "join"):
                how = "semi"
            elif self.accept("left", "anti", "join"):
                how = "anti"
            else:
                return found
            if found:
                raise ExprError("only two tables can be joined in one statement", self.at())
            table = self.name("a table")
            alias = self.alias() or table
            self.refuse()
            self.need("on")
            on = [self.on()]
            while self.accept("and"):
                on.append(self.on())
            found = Join(table, alias, how, tuple(on))

    def on(self) -> tuple[Node, Node]:
        left = self.column()
        if not self.accept("="):
            raise ExprError("a join compares columns with `=`", self.at())
        return left, self.column()

    def column(self) -> Node:
        at = self.at()
        first = self.name("a column")
        if self.accept("."):
            return Node("col", at, self.name("a column"), value=first)
        if self.sign() == "(":
            raise ExprError("a plain column is needed here; compute it in the select list or in another cell", at)
        return Node("col", at, first)

    # -- expressions
    def expr(self) -> Node:
        left = self.conjunction()
        while self.word() == "or":
            at = self.step()[2]
            left = operator("or", left, self.conjunction(), at=at)
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.word() == "and":
            at = self.step()[2]
            left = operator("and", left, self.negation(), at=at)
        return left

    def negation(self) -> Node:
        if self.word() == "not":
            at = self.step()[2]
            return Node("not", at, args=(self.negation(),))
        return self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        at = self.at()
        if (said := self.sign()) in ("=", "<>", "!=", "<", "<=", ">", ">="):
            self.step()
            right = self.sum()
            if self.sign() in ("=", "<>", "!=", "<", "<=", ">", ">="):
                raise ExprError("comparisons do not chain; join two of them with `and`", self.at())
            return operator({"=": "==", "<>": "!="}.get(said, said), left, right, at=at)
        if self.accept("is"):
            turned = self.accept("not")
            self.need("null")
            test = call("is_null", left, at=at)
            return Node("not", at, args=(test,)) if turned else test
        turned = self.word() == "not" and self.word(1) in ("between", "in", "like", "ilike") and bool(self.step())
        self.refuse()
        if self.accept("between"):
            low = self.sum()
            self.need("and")
            high = self.sum()
            test = operator("and", operator(">=", left, low, at=at), operator("<=", left, high, at=at), at=at)
        elif self.accept("in"):
            self.need("(")
            if self.word() == "select":
                raise ExprError("a subquery is not supported; use a semi join with another cell", self.at())
            test = operator("==", left, self.expr(), at=at)
            while self.accept(","):
                test = operator("or", test, operator("==", left, self.expr(), at=at), at=at)
            self.need(")")
        else:
            return left
        return Node("not", at, args=(test,)) if turned else test

    def sum(self) -> Node:
        left = self.product()
        while (said := self.sign()) in ("+", "-", "||"):
            at = self.step()[2]
            right = self.product()
            left = call("concat", left, right, at=at) if said == "||" else operator(said, left, right, at=at)
        return left

    def product(self) -> Node:
        left = self.unary()
        while (said := self.sign()) in ("*", "/", "%"):
            at = self.step()[2]
            left = operator(said, left, self.unary(), at=at)
        return left

    def unary(self) -> Node:
        at = self.at()
        if self.accept("-"):
            if self._tokens[self._next][:2] == ("number", str(I64_MAX + 1)):
                self.step()
                return literal(I64_MIN, at)
            return Node("neg", at, args=(self.unary(),))
        self.accept("+")
        found = self.primary()
        if self.sign() == "::":
            raise ExprError(REFUSED["cast"], self.at())
        return found

    def primary(self) -> Node:
        self.refuse()
        kind, said, at = self._tokens[self._next]
        word = self.word()
        if kind == "number":
            self.step()
            return literal(read_number(said, at), at)
        if kind == "text":
            self.step()
            return literal(said[1:-1].replace("''", "'"), at)
        if kind == "param":
            self.step()
            return Node("param", at, said[1:])
        if word in ("true", "false", "null"):
            self.step()
            return literal({"true": True, "false": False, "null": None}[word], at)
        if self.accept("("):
            if self.word() == "select":
                raise ExprError("a subquery is not supported; make it a cell of its own", self.at())
            inner = self.expr()
            self.need(")")
            return inner
        if self.accept("case"):
            return self.case(at)
        first = self.name("an expression")
        if self.accept("."):
            return Node("col", at, self.name("a column"), value=first)
        if kind == "word" and self.accept("("):
            return self.called(first.lower(), at)
        return Node("col", at, first)

    def called(self, name: str, at: int) -> Node:
        if self.word() == "distinct":
            raise ExprError("aggregates over distinct values are not supported", self.at())
        star = self.accept("*")
        args: list[Node] = []
        if not star and not self.accept(")"):
            args.append(self.expr())
            while self.accept(","):
                args.append(self.expr())
            self.need(")")
        elif star:
            self.need(")")
        if self.word() == "over":
            raise ExprError(REFUSED["over"], self.at())
        if name == "count":
            if not star:
                raise ExprError("only count(*) is supported; it counts rows", at)
            return Node("agg", at, "count")
        if star:
            raise ExprError(f"`{name}` does not take `*`", at)
        if name in ("sum", "avg") or (name in ("min", "max") and len(args) == 1):
            if len(args) != 1:
                raise ExprError(f"`{name}` takes 1 argument, not {len(args)}", at)
            return Node("agg", at, AGGREGATE_NAMES[name], (args[0],))
        if name not in FUNCTIONS:
            raise ExprError(f"there is no function `{name}`" + hint(name, [*FUNCTIONS, *AGGREGATE_NAMES]), at)
        return call(name, *args, at=at)

    def case(self, at: int) -> Node:
        subject = None if self.word() == "when" else self.expr()
        arms = []
        while self.accept("when"):
            test = self.expr()
            self.need("then")
            arms.append((test if subject is None else operator("==", subject, test, at=at), self.expr()))
        if not arms:
            raise ExprError("`case` needs a `when`", self.at())
        result = self.expr() if self.accept("else") else literal(None, at)
        self.need("end")
        for test, value in reversed(arms):
            result = call("if", test, value, result, at=at)
        return result


def parse_select(text: str) -> Select:
    return _Parser(text).statement()


# ---------------------------------------------------------------- lowering

_FLIPPED = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_FILTER_OPS = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


class _Lowering:
    """Turns a parsed statement into steps, given the columns of its tables."""

    def __init__(self, select: Select, schema_of) -> None:  # noqa: ANN001
        self.select, self.schema_of = select, schema_of
        self.steps: list[Step] = []
        self.left = self._columns(select.table)
        self.names = list(self.left)
        self.renamed: dict[tuple[str, str], str] = {}

    def _columns(self, table: str) -> list[str]:
        return [n for n, _ in self.schema_of(table)]

    def run(self) -> list[Step]:
        s = self.select
        if s.join:
            self._join(s.join)
        if s.where is not None:
            self._where(self._plain(s.where))
        outputs = self._outputs()
        sort = None
        if s.order:
            key = s.order[0]
            sort = key.name if key.value is None and key.name in [n for n, _, _ in outputs] else self._plain(key).name
        if s.group is not None or any(_has_agg(e) for _, e, _ in outputs):
            shown = self._grouped(outputs)
        else:
            shown = self._projected(outputs)
        if sort is not None:
            place = dict(shown).get(sort, sort)
            if place not in self.names:
                raise ExprError(f"there is no column `{sort}` to sort by" + hint(sort, self.names), s.order[0].at)
            self.steps.append(Step("sort", {"column": place, "descending": s.order[1]}))
        self._final(shown)
        if s.limit is not None:
            self.steps.append(Step("limit", {"n": s.limit}))
        return self.steps

    # -- names
    def _plain(self, node: Node) -> Node:
        """Columns without their table, checked."""
        if node.kind == "col":
            return replace(node, name=self._resolve(node), value=None)
        return replace(node, args=tuple(self._plain(a) for a in node.args))

    def _resolve(self, node: Node) -> str:
        s, table = self.select, node.value
        tables = {s.alias: self.left}
        if s.join and s.join.how in ("inner", "left"):
            tables[s.join.alias] = self._columns(s.join.table)
        if table is not None and table not in tables:
            raise ExprError(f"there is no table `{table}` here" + hint(table, list(tables)), node.at)
        known = tables[table] if table is not None else self.names
        if node.name not in known:
            raise ExprError(f"there is no column `{node.name}`" + hint(node.name, known), node.at)
        if table is not None and (table, node.name) in self.renamed:
            return self.renamed[table, node.name]
        return node.name

    # -- clauses
    def _join(self, join: Join) -> None:
        left_on, right_on = [], []
        right = self._columns(join.table)
        for a, b in join.on:
            sides = {}
            for c in (a, b):
                if c.value is None:
                    raise ExprError(f"say which table `{c.name}` belongs to", c.at)
                if c.value not in (self.select.alias, join.alias):
                    raise ExprError(f"there is no table `{c.value}` here" + hint(c.value, [self.select.alias, join.alias]), c.at)
                known = self.left if c.value == self.select.alias else right
                if c.name not in known:
                    raise ExprError(f"there is no column `{c.name}` in `{c.value}`" + hint(c.name, known), c.at)
                sides[c.value] = c.name
            if len(sides) != 2:
                raise ExprError("a join condition compares one column of each table", a.at)
            left_on.append(sides[self.select.alias])
            right_on.append(sides[join.alias])
        self.steps.append(Step("join", {"with": join.table, "spec": JoinSpec(tuple(left_on), tuple(right_on), join.how)}))
        if join.how in ("inner", "left"):
            self.names += [n for n in right if n not in right_on]
            self.renamed = {(join.alias, b): a for a, b in zip(left_on, right_on, strict=True)}

    def _where(self, node: Node) -> None:
        if node.kind == "op" and node.name == "and":
            for part in node.args:
                self._where(part)
            return
        if _has_agg(node):
            raise ExprError("an aggregate cannot stand in `where`", node.at)
        if (simple := _simple_filter(node)) is not None:
            self.steps.append(simple)
            return
        name = self._derive("__where", node)
        self.steps.append(Step("filter", {"column": name, "op": "eq", "value": True}))

    def _derive(self, stem: str, node: Node, name: str | None = None) -> str:
        if name is None:
            number = 0
            while f"{stem}{number}" in self.names:
                number += 1
            name = f"{stem}{number}"
        self.steps.append(Step("derive", {"name": name, "expr": node, "params": tuple(sorted(names_in(node, "param")))}))
        self.names.append(name)
        return name

    def _outputs(self) -> list[tuple[str, Node, int]]:
        """(output name, expression, place) of every item, stars expanded."""
        out = []
        for item in self.select.items:
            if item.expr is None:
                if self.select.group is not None:
                    raise ExprError("`*` cannot be combined with `group by`", item.at)
                out += [(n, Node("col", item.at, n), item.at) for n in self.names if not n.startswith("__where")]
                continue
            node = self._plain(item.expr)
            if item.name is None and node.kind != "col":
                raise ExprError("a computed column needs a name: write `... as name`", item.at)
            out.append((item.name or item.expr.name, node, item.at))
        names = [n for n, _, _ in out]
        for name, _, at in out:
            if names.count(name) > 1:
                raise ExprError(f"two columns are called `{name}`", at)
        return out

    def _projected(self, outputs: list[tuple[str, Node, int]]) -> list[tuple[str, str]]:
        shown = []
        for name, node, _ in outputs:
            if node.kind == "col" and node.name == name:
                shown.append((name, name))
            else:
                shown.append((name, self._derive("__out", node, name if name not in self.names else None)))
        return shown

    def _grouped(self, outputs: list[tuple[str, Node, int]]) -> list[tuple[str, str]]:
        keys = [self._plain(k).name for k in self.select.group or ()]
        aggs: dict[Node, str] = {}

        def collect(node: Node) -> Node:
            """The expression with its aggregates replaced by the columns that will hold them."""
            if node.kind == "agg":
                bare = _bare(node)
                if bare not in aggs:
                    aggs[bare] = f"__agg{len(aggs)}"
                return Node("col", node.at, aggs[bare])
            return replace(node, args=tuple(collect(a) for a in node.args))

        after = [(name, collect(node), at) for name, node, at in outputs]
        for _, node, at in after:
            if loose := next((c for c in names_in(node, "col") if c not in keys and not c.startswith("__agg")), None):
                raise ExprError(f"`{loose}` is neither grouped by nor aggregated", at)
        made = []
        for node, name in aggs.items():
            column = None
            if node.args:
                inner = node.args[0]
                if _has_agg(inner):
                    raise ExprError("an aggregate cannot hold another", inner.at)
                column = inner.name if inner.kind == "col" else self._derive("__arg", inner)
            made.append(Agg(node.name, name, column))
        if not made:  # keys alone: their distinct combinations
            made.append(Agg("count", "__agg0"))
        self.steps.append(Step("group_by", {"by": keys, "aggs": made}))
        self.names = [*keys, *(a.name for a in made)]
        return self._projected(after)

    def _final(self, shown: list[tuple[str, str]]) -> None:
        """Select the outputs; a column that had to be computed under another name gets its own."""
        taken = {place for _, place in shown}
        for i, (name, place) in enumerate(shown):
            if name != place:
                if name in self.names and name not in taken:
                    # an input column of that name is in the way and not wanted: drop it first
                    self.steps.append(Step("select", {"names": [p for _, p in shown]}))
                    self.names = [p for _, p in shown]
                if name in self.names:
                    raise ExprError(f"`{name}` is computed and selected under one name", None)
                self._derive("", Node("col", 0, place), name)
                shown[i] = (name, name)
        self.steps.append(Step("select", {"names": [p for _, p in shown]}))


def _bare(node: Node) -> Node:
    """The same tree without places, so equal aggregates are one."""
    return replace(node, at=0, args=tuple(_bare(a) for a in node.args))


def _has_agg(node: Node) -> bool:
    return node.kind == "agg" or any(_has_agg(a) for a in node.args)


def _constant(node: Node) -> object | None:
    if node.kind == "param":
        return Param(node.name)
    if node.kind == "neg" and node.args[0].kind == "lit" and type(node.args[0].value) in (int, float):
        return -node.args[0].value
    return node.value if node.kind == "lit" and node.value is not None else None


def _simple_filter(node: Node) -> Step | None:
    """A filter step where the conjunct is one column against one value."""
    if node.kind == "op" and node.name in _FILTER_OPS:
        left, right, op = node.args[0], node.args[1], node.name
        if left.kind != "col":
            left, right, op = right, left, _FLIPPED[op]
        if left.kind == "col" and (value := _constant(right)) is not None:
            return Step("filter", {"column": left.name, "op": _FILTER_OPS[op], "value": value})
    if node.kind == "call" and node.name == "contains" and len(node.args) == 2 and node.args[0].kind == "col":
        if isinstance(value := _constant(node.args[1]), str):
            return Step("filter", {"column": node.args[0].name, "op": "contains", "value": value})
    return None


def tables_of(text: str) -> list[str]:
    """The tables a statement reads."""
    s = parse_select(text)
    return [s.table, *([s.join.table] if s.join else [])]


def lower(text: str, schema_of) -> tuple[str, list[Step]]:  # noqa: ANN001
    """(table, steps) of a statement; ``schema_of(table)`` gives (name, type) pairs."""
    select = parse_select(text)
    return select.table, _Lowering(select, schema_of).run()
