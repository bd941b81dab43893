"""The registered queries over the driver's tables, one per operator, each with its SQL.

``net_by_flag`` is the flagship.  Sums are rounded in both engines, since neither adds
floats in a fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import verbs
from .operators.relation import Relation
from .operators.verbs import Agg, JoinSpec, Step
from .plans import sql as dialect
from .sources.others import read_parquet

#: Projections that make a driver table fit the four column types; other tables are taken whole.
PROJECTIONS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "date_format(o_orderdate, 'yyyy-MM-dd') as o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "date_format(l_shipdate, 'yyyy-MM-dd') as l_shipdate",
    ],
    "events": ["event_id", "user_id", "event_type", "value", "props"],
    "embeddings": ["vec_id", "label"],
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> Relation:
    return read_parquet(spark, f"{sf_dir}/{table}.parquet", PROJECTIONS.get(table))


def _add(name: str, oracle: str, build: Callable[[Callable[[str], Relation]], Relation]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(lambda t: load(spark, sf_dir, t)).visible()
    ORACLE_SQL[name] = oracle


def _steps(name: str, table: str, steps: list[Step], oracle: str) -> None:
    _add(name, oracle, lambda t: verbs.run_steps(t(table), steps, {}))


def _expr(name: str, table: str, keys: str, expr: str, oracle: str) -> None:
    """One derived column beside the keys."""
    names = keys.split(", ")
    kept = ", ".join(f"{k}::BIGINT AS {k}" if k.endswith(("key", "number", "_id")) else k for k in names)
    steps = [Step("derive", {"name": "x", "expr": expr, "params": ()}), Step("select", {"names": [*names, "x"]})]
    _steps(name, table, steps, f"SELECT {kept}, {oracle} AS x FROM {table}")


def _filter(column: str, op: str, value: object) -> Step:
    return Step("filter", {"column": column, "op": op, "value": value})


def _group(by: list[str], *aggs: tuple[str, str, str | None]) -> Step:
    return Step("group_by", {"by": by, "aggs": [Agg(*a) for a in aggs]})


def _round(column: str) -> list[Step]:
    """Round a float column to four digits under the name ``column``_r."""
    return [Step("derive", {"name": f"{column}_r", "expr": f"round({column} * 100) / 100", "params": ()})]


def _rounded(x: str) -> str:
    return f"round(({x}) * 100) / 100"


# ---------------------------------------------------------------- flagship
_steps(
    "net_by_flag", "lineitem",
    [
        Step("derive", {"name": "net", "expr": "l_extendedprice * (1 - l_discount)", "params": ()}),
        _filter("l_quantity", "le", 45), _group(["l_returnflag", "l_linestatus"], ("sum", "net", "net"), ("count", "n")),
        *_round("net"), Step("sort", {"column": "net", "descending": True}), Step("select", {"names": ["l_returnflag", "l_linestatus", "n", "net_r"]}),
    ],
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {_rounded('sum(l_extendedprice * (1 - l_discount))')} AS net_r
    FROM lineitem WHERE l_quantity <= 45 GROUP BY ALL""",
)

# ---------------------------------------------------------------- scans and filters
_add("scan_types", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part", lambda t: t("part"))
_add("alias", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region", lambda t: verbs.run_steps(t("region"), [], {}))
for _op, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _steps(f"filter_{_op}", "lineitem", [_filter("l_quantity", _op, 17), Step("select", {"names": ["l_orderkey", "l_linenumber", "l_quantity"]})],
           f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sign} 17")
_steps("filter_contains", "part", [_filter("p_type", "contains", "OM"), Step("select", {"names": ["p_partkey", "p_type"]})],
       "SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'OM')")
_steps("filter_other_type", "orders", [_filter("o_orderstatus", "ne", 1), Step("select", {"names": ["o_orderkey"]})],
       "SELECT o_orderkey FROM orders WHERE false")
_steps("filter_skip", "customer",
       [Step("filter", {"column": "c_mktsegment", "op": "eq", "value": "all", "skip_when": "all"}), Step("select", {"names": ["c_custkey"]})],
       "SELECT c_custkey FROM customer")
_steps("filter_nulls", "customer",
       [Step("derive", {"name": "x", "expr": "if(c_acctbal > 5000, c_nationkey, null)", "params": ()}), _filter("x", "ne", 3), Step("select", {"names": ["c_custkey", "x"]})],
       "SELECT c_custkey, c_nationkey::BIGINT AS x FROM customer WHERE c_acctbal > 5000 AND c_nationkey <> 3")
_steps("select_reorder", "supplier", [Step("select", {"names": ["s_name", "s_suppkey"]})], "SELECT s_name, s_suppkey FROM supplier")

# ---------------------------------------------------------------- expressions
_L = "l_orderkey, l_linenumber"
_expr("derive_arith", "lineitem", _L, "l_linenumber * 3 - l_orderkey + -l_partkey", "(l_linenumber * 3 - l_orderkey + -l_partkey)::BIGINT")
_expr("derive_overflow", "lineitem", _L, "l_linenumber * 9000000000000000000",
      "CASE WHEN l_linenumber <= 1 THEN l_linenumber::BIGINT * 9000000000000000000 END")
_expr("derive_div_null", "lineitem", _L, "l_quantity / (l_linenumber - 1)", "l_quantity / NULLIF(l_linenumber - 1, 0)")
_expr("derive_mod", "lineitem", _L, "l_orderkey % (l_linenumber - 1)", "l_orderkey % NULLIF(l_linenumber - 1, 0)")
_expr("derive_cmp", "lineitem", _L, "l_quantity >= l_linenumber", "l_quantity >= l_linenumber")
_N = "if(l_quantity > 10, l_quantity > 30, null)"
_NS = "CASE WHEN l_quantity > 10 THEN l_quantity > 30 END"
_expr("derive_or_null", "lineitem", _L, f"{_N} or l_linenumber > 2", f"CASE WHEN l_quantity > 10 THEN {_NS} OR l_linenumber > 2 END")
_expr("derive_and_null", "lineitem", _L, f"{_N} and l_linenumber > 2", f"CASE WHEN l_quantity > 10 THEN {_NS} AND l_linenumber > 2 END")
_expr("derive_not", "lineitem", _L, f"not ({_N})", f"NOT ({_NS})")
_expr("derive_if_null", "lineitem", _L, f"if({_N}, 'many', 'few')", f"CASE WHEN {_NS} THEN 'many' WHEN NOT ({_NS}) THEN 'few' END")
_expr("fn_abs", "customer", "c_custkey", "abs(c_acctbal - 5000)", "abs(c_acctbal - 5000)")
_expr("fn_round", "customer", "c_custkey", "round(c_acctbal / 100)", "round(c_acctbal / 100)")
_expr("fn_floor", "customer", "c_custkey", "floor(c_acctbal / 100)", "floor(c_acctbal / 100)")
_expr("fn_ceil", "customer", "c_custkey", "ceil(c_acctbal / 100)", "ceil(c_acctbal / 100)")
_expr("fn_min", "lineitem", _L, "min(l_partkey, l_suppkey * 10)", "least(l_partkey, l_suppkey * 10)")
_expr("fn_max", "lineitem", _L, "max(l_linenumber, l_tax * 50)", "greatest(l_linenumber::DOUBLE, l_tax * 50)")
_expr("fn_lower", "customer", "c_custkey", "lower(c_mktsegment)", "lower(c_mktsegment)")
_expr("fn_upper", "nation", "n_nationkey", "upper(n_name)", "upper(n_name)")
_expr("fn_trim", "customer", "c_custkey", "trim(concat('  ', c_name, ' '))", "c_name")
_expr("fn_len", "documents", "doc_id", "len(text)", "length(text)")
_expr("fn_concat", "part", "p_partkey", "concat(p_brand, '/', p_type)", "p_brand || '/' || p_type")
_expr("fn_contains", "part", "p_partkey", "contains(p_type, 'AN')", "contains(p_type, 'AN')")
_expr("fn_coalesce", "customer", "c_custkey", "coalesce(if(c_acctbal > 5000, c_acctbal, null), -1)",
      "CASE WHEN c_acctbal > 5000 THEN c_acctbal ELSE -1 END")
_expr("fn_is_null", "customer", "c_custkey", "is_null(if(c_acctbal > 5000, c_acctbal, null))", "NOT c_acctbal > 5000")
_expr("fn_if", "orders", "o_orderkey", "if(o_totalprice > 100000, 'large', o_orderstatus)",
      "CASE WHEN o_totalprice > 100000 THEN 'large' ELSE o_orderstatus END")

# ---------------------------------------------------------------- joins
def _joined(how: str, left: str, right: str, on: tuple[str, str], keep: list[str], oracle: str) -> None:
    many = right in ("orders", "lineitem") and how in ("inner", "left")

    def build(t: Callable[[str], Relation]) -> Relation:
        return verbs.select(verbs.join(t(left), t(right), JoinSpec((on[0],), (on[1],), how, multiple=many)), keep)

    _add(f"join_{how}" + ("_multiple" if many else ""), oracle, build)


_joined("inner", "orders", "customer", ("o_custkey", "c_custkey"), ["o_orderkey", "c_name"],
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_joined("left", "customer", "orders", ("c_custkey", "o_custkey"), ["c_custkey", "o_orderkey"],
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
_joined("semi", "customer", "supplier", ("c_custkey", "s_suppkey"), ["c_custkey", "c_name"],
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
_joined("anti", "customer", "supplier", ("c_custkey", "s_suppkey"), ["c_custkey", "c_name"],
        "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
_add("join_left", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
     lambda t: verbs.join(t("nation"), t("region"), JoinSpec(("n_regionkey",), ("r_regionkey",), "left")))
_add("join_composite", """SELECT a.l_orderkey, a.l_linenumber::BIGINT AS l_linenumber, b.l_tax AS l_tax_r FROM lineitem a JOIN lineitem b
     ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""",
     lambda t: verbs.select(verbs.join(
         verbs.select(t("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]),
         verbs.select(t("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax"]),
         JoinSpec(*[("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")] * 2, "inner", "_r", True)), ["l_orderkey", "l_linenumber", "l_tax_r"]))
_add("join_null_keys", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_acctbal > 0 AND c_nationkey = n_nationkey",
     lambda t: verbs.select(verbs.join(
         verbs.derive(t("customer"), "k", "if(c_acctbal > 0, c_nationkey, null)"),
         t("nation"), JoinSpec(("k",), ("n_nationkey",), "left")), ["c_custkey", "n_name"]))
_add("join_suffix", "SELECT a.r_regionkey::BIGINT AS r_regionkey, a.r_name, b.r_name AS r_name_again FROM region a JOIN region b USING (r_regionkey)",
     lambda t: verbs.join(t("region"), t("region"), JoinSpec(("r_regionkey",), ("r_regionkey",), "inner", "_again")))

# ---------------------------------------------------------------- aggregates
_steps("agg_count", "orders", [_group(["o_orderstatus"], ("count", "n"))], "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
for _agg, _fn in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):
    _steps(f"agg_{_agg}", "lineitem", [_group(["l_returnflag"], (_agg, "v", "l_extendedprice"), (_agg, "k", "l_linenumber")), *_round("v"), Step("select", {"names": ["l_returnflag", "v_r", "k"]})],
           f"SELECT l_returnflag, {_rounded(f'{_fn}(l_extendedprice)')} AS v_r, {_fn}(l_linenumber)::DOUBLE AS k FROM lineitem GROUP BY ALL")
_steps("agg_minmax_text", "part", [_group(["p_brand"], ("min", "a", "p_name"), ("max", "b", "p_name"))],
       "SELECT p_brand, min(p_name) AS a, max(p_name) AS b FROM part GROUP BY ALL")
_steps("agg_max_nan", "customer",
       [Step("derive", {"name": "v", "expr": "if(c_acctbal > 9000, c_acctbal, 1e308 * 10 - 1e308 * 10)", "params": ()}), _group(["c_nationkey"], ("max", "m", "v"), ("min", "k", "v"))],
       """SELECT c_nationkey::BIGINT AS c_nationkey, coalesce(max(c_acctbal) FILTER (c_acctbal > 9000), 'nan'::DOUBLE) AS m,
       coalesce(min(c_acctbal) FILTER (c_acctbal > 9000), 'nan'::DOUBLE) AS k FROM customer GROUP BY ALL""")  # fmt: skip
_steps("agg_null_key", "customer",
       [Step("derive", {"name": "k", "expr": "if(c_acctbal > 5000, c_mktsegment, null)", "params": ()}), _group(["k"], ("count", "n"))],
       "SELECT CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS k, count(*) AS n FROM customer GROUP BY ALL")
_steps("agg_global", "orders", [_group([], ("count", "n"), ("max", "m", "o_totalprice"))], "SELECT count(*) AS n, max(o_totalprice) AS m FROM orders")
_steps("agg_global_empty", "orders", [_filter("o_totalprice", "lt", -1), _group([], ("count", "n"), ("sum", "s", "o_totalprice"))],
       "SELECT 0::BIGINT AS n, NULL::DOUBLE AS s")
_steps("agg_distinct_keys", "lineitem", [_group(["l_returnflag", "l_linestatus"])], "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_steps("agg_first_appearance", "customer",
       [Step("sort", {"column": "c_custkey", "descending": True}), _group(["c_mktsegment"], ("count", "n")), Step("limit", {"n": 2})],
       "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL ORDER BY max(c_custkey) DESC LIMIT 2")

# ---------------------------------------------------------------- order and ends of pipelines
_steps("topk", "orders", [Step("sort", {"column": "o_totalprice", "descending": True}), Step("limit", {"n": 25}), Step("select", {"names": ["o_orderkey", "o_totalprice"]})],
       "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_steps("sort_nulls_last", "customer",
       [Step("derive", {"name": "x", "expr": "if(c_acctbal > 9000, c_acctbal, null)", "params": ()}), Step("sort", {"column": "c_custkey"}), Step("sort", {"column": "x"}),
        Step("limit", {"n": 400}), Step("select", {"names": ["c_custkey", "x"]})],
       """SELECT c_custkey, x FROM (SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN c_acctbal END AS x FROM customer)
       ORDER BY x NULLS LAST, c_custkey LIMIT 400""")  # fmt: skip
_steps("sort_text_desc", "part", [Step("sort", {"column": "p_partkey"}), Step("sort", {"column": "p_name", "descending": True}), Step("limit", {"n": 60}), Step("select", {"names": ["p_partkey", "p_name"]})],
       "SELECT p_partkey, p_name FROM part ORDER BY p_name DESC, p_partkey LIMIT 60")


def _value(name: str, kind: str, oracle: str, build: Callable[[Callable[[str], Relation]], object]) -> None:
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame([(build(lambda t: load(spark, sf_dir, t)),)], f"value {kind}")
    ORACLE_SQL[name] = oracle


_value("scalar", "double", "SELECT max(o_totalprice) AS value FROM orders",
       lambda t: verbs.scalar(verbs.sort(t("orders"), "o_totalprice", True), "o_totalprice"))
_value("scalar_past_end", "double", "SELECT NULL::DOUBLE AS value", lambda t: verbs.scalar(t("region"), "r_regionkey", 99))
_value("count", "bigint", "SELECT count(*) AS value FROM lineitem WHERE l_returnflag = 'R'",
       lambda t: verbs.count(verbs.filter_rows(t("lineitem"), "l_returnflag", "eq", "R")))


# ---------------------------------------------------------------- the SQL dialect
def _sql(name: str, text: str, oracle: str | None = None) -> None:
    def build(t: Callable[[str], Relation]) -> Relation:
        tables: dict[str, Relation] = {}

        def schema(n: str) -> list[tuple[str, str]]:
            if n not in tables:
                tables[n] = t(n)
            return tables[n].schema

        table, steps = dialect.lower(text, schema)
        return verbs.run_steps(tables[table], steps, dict(tables))

    _add(name, oracle or text, build)


_sql("sql_where", "select l_orderkey, l_quantity from lineitem where l_quantity > 20 and 0.05 <= l_discount and contains(l_returnflag, 'R')")
_sql("sql_group", "select l_returnflag, count(*) as n, max(l_tax) as t from lineitem where l_quantity < 24 group by l_returnflag order by n desc")
_sql("sql_agg_expr", "select o_orderstatus, round(sum(o_totalprice) / count(*)) as m, max(o_totalprice) - min(o_totalprice) as spread from orders group by o_orderstatus")
_sql("sql_case", "select o_orderkey, case when o_totalprice > 200000 then 'a' when o_totalprice > 100000 then 'b' else 'c' end as class from orders")
_sql("sql_case_simple", "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' end as s from orders")
_sql("sql_case_null", "select c_custkey, case when case when c_acctbal > 0 then c_nationkey > 3 end then 'a' else 'b' end as x from customer",
     "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_nationkey > 3 THEN 'a' ELSE 'b' END END AS x FROM customer")
_sql("sql_in", "select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority not in ('1-URGENT')")
_sql("sql_between", "select c_custkey, c_acctbal from customer where c_acctbal between 100 and 900.5 and c_nationkey not between 3 and 9")
_sql("sql_is_null", "select c_custkey, case when c_acctbal > 5000 then 1 end is null as x from customer")
_sql("sql_concat", "select c_custkey, c_name || ' / ' || c_mktsegment as x from customer")
_sql("sql_join", "select o.o_orderkey, c.c_name, c.c_acctbal * 2 as twice from orders o join customer c on o.o_custkey = c.c_custkey where c.c_acctbal > 5000")
_sql("sql_left_join", "select n.n_name, r.r_name from nation n left outer join region r on n.n_regionkey = r.r_regionkey")
_sql("sql_semi", "select c_custkey from customer c left semi join supplier s on c.c_custkey = s.s_suppkey",
     "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
_sql("sql_anti", "select c_custkey from customer c left anti join supplier s on c.c_custkey = s.s_suppkey",
     "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
_sql("sql_order_limit", "select o_orderkey from orders order by o_totalprice desc limit 7")
_sql("sql_star", "select * from region -- all of it", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
_sql("sql_keys_only", "select c_mktsegment from customer group by c_mktsegment")


# ---------------------------------------------------------------- reactive apps
_APP = """
[app]
title = "orders"
[[source]]
name = "orders"
parquet = "orders.parquet"
columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
[[input]]
name = "floor"
slider = { min = 0.0, max = 500000.0, default = 0.0 }
[[cell]]
name = "large"
from = "orders"
step = [{ filter = { column = "o_totalprice", op = "ge", param = "floor" } }]
[[cell]]
name = "by_status"
from = "large"
step = [
  { group_by = { by = ["o_orderstatus"], agg = [{ agg = "count", as = "n" }] } },
  { sort = { column = "o_orderstatus" } },
]
[[cell]]
name = "statuses"
sql = "select o_orderstatus from by_status order by o_orderstatus"
[[cell]]
name = "how_many"
from = "statuses"
step = [{ count = true }]
[[pane]]
cell = "by_status"
table = {}
[[pane]]
cell = "how_many"
metric = { label = "Statuses" }
"""


def _viewer(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    from .plans.app import AppSession
    from .plans.manifest import compile_app

    return AppSession(compile_app(_APP, spark, sf_dir))


def _app_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    viewer = _viewer(spark, sf_dir)
    viewer.set({"floor": 150000.0})
    return viewer.core.value("by_status").visible()


def _app_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    viewer = _viewer(spark, sf_dir)
    rows = [("first", s.cell, s.outcome, s.changed) for s in viewer.trace.steps]
    viewer.set({"floor": 150000.0})
    rows += [("second", s.cell, s.outcome, s.changed) for s in viewer.trace.steps]
    return spark.createDataFrame(rows, "pass string, cell string, outcome string, changed boolean")


QUERIES |= {"reactive_value": _app_value, "reactive_trace": _app_trace}
ORACLE_SQL |= {
    "reactive_value": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= 150000 GROUP BY ALL",
    "reactive_trace": """SELECT * FROM (VALUES ('first', 'large', 'evaluated', true), ('first', 'by_status', 'evaluated', true),
      ('first', 'statuses', 'evaluated', true), ('first', 'how_many', 'evaluated', true), ('second', 'floor', 'set', true),
      ('second', 'large', 'evaluated', true), ('second', 'by_status', 'evaluated', true), ('second', 'statuses', 'reused', false), ('second', 'how_many', 'reused', false))
      t(pass, cell, outcome, changed)""",
}
