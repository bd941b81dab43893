"""The SQL dialect: equivalence with steps, refusals by name."""

from __future__ import annotations

import pytest

from tidegraph.operators import verbs
from tidegraph.operators.relation import from_dataframe
from tidegraph.operators.verbs import Agg
from tidegraph.plans import sql
from tidegraph.types import EngineError


@pytest.fixture(scope="module")
def tables(spark):
    sales = spark.createDataFrame([("n", 10.0, 1), ("s", 30.0, 3), ("n", 5.0, None), (None, 1.0, 2)], "region string, amount double, units int")
    names = spark.createDataFrame([("n", "North"), ("s", "South")], "code string, label string")
    return {"sales": from_dataframe(sales.coalesce(1)), "names": from_dataframe(names.coalesce(1))}


def run(tables, text, **params):
    table, steps = sql.lower(text, lambda n: tables[n].schema)
    return verbs.run_steps(tables[table], steps, {**params, **tables})


def test_against_steps(tables):
    s = tables["sales"]
    pairs = [
        ("select region, amount from sales where amount >= 5", verbs.select(verbs.filter_rows(s, "amount", "ge", 5), ["region", "amount"])),
        ("select region, sum(amount) as t from sales group by region order by t desc",
         verbs.sort(verbs.group_by(s, ["region"], [Agg("sum", "t", "amount")]), "t", True)),
        ("select units from sales order by amount limit 2", verbs.select(verbs.limit(verbs.sort(s, "amount"), 2), ["units"])),
        ("select * from sales where 10 > amount", verbs.filter_rows(s, "amount", "lt", 10)),
    ]
    for text, wanted in pairs:
        got = run(tables, text)
        assert got.names == wanted.names and got.head(9) == wanted.head(9), text


@pytest.mark.parametrize(("text", "rows"), [
    ("select amount * 2 as a, amount from sales where region = :r", [(20.0, 10.0), (10.0, 5.0)]),
    ("select amount from sales where units in (1, null)", []),
    ("select amount from sales where not (units = 1)", [(30.0,), (1.0,)]),
    ("select amount from sales where units is null or amount > 20", [(30.0,), (5.0,)]),
    ("select case when units > 1 then 'x' end as c from sales", [(None,), ("x",), (None,), ("x",)]),
    ("select s.amount, n.label from sales s left join names n on s.region = n.code where s.amount < 20",
     [(10.0, "North"), (5.0, "North"), (1.0, None)]),
    ("select n.code from names n left semi join sales s on s.region = n.code", [("n",), ("s",)]),
    ("select count(*) as n, avg(amount + 1) as m from sales", [(4, 12.5)]),
    ("select max(amount) - min(amount) as d from sales where units > 0", [(29.0,)]),
    ("select min(amount, 7) as a from sales limit 2", [(7.0,), (7.0,)]),
    ("select region as amount from sales limit 1", [("n",)]),
    ("select region || '!' as r /* loud */ from sales limit 1 -- end", [("n!",)]),
])
def test_rows(tables, text, rows):
    assert run(tables, text, r="n").head(9) == rows


@pytest.mark.parametrize(("text", "said"), [
    ("select distinct region from sales", "distinct"), ("select region from sales having 1 = 1", "having"),
    ("select region from sales union select 1", "union"), ("with x as (select 1) select 1 from x", "common table"),
    ("select * from (select 1) x", "subquery"), ("select amount from sales where region in (select code from names)", "subquery"),
    ("select cast(amount as int) as a from sales", "cast"), ("select amount::int as a from sales", "cast"),
    ("select amount from sales where region like 'n%'", "like"), ("select sum(amount) over () as s from sales", "window"),
    ("select 1 as a from sales right join names on a = b", "right join"), ("select 1 as a from sales cross join names", "cross join"),
    ("select amount from sales offset 3", "offset"), ("select count(amount) as n from sales", r"count\(\*\)"),
    ("select sum(distinct amount) as s from sales", "distinct"), ("select amount from sales order by amount, units", "one sort column"),
    ("select amount + 1 from sales", "needs a name"), ("select region, count(*) as n from sales", "neither grouped"),
    ("select amont from sales", "did you mean `amount`"), ("select amount from sales, names", "join"),
    ("select *, count(*) as n from sales group by region", r"\*"), ("select sum() as s from sales", "1 argument"),
    ("select sum(amount, units) as s from sales", "1 argument"), ("select amount as a, units as a from sales", "two columns"),
    ("select sum(amount) as region, region from sales group by region", "two columns"), ("delete from sales", "only `select`"),
    ("select amount from sales limit 1.5", "whole number"), ("select amount from sales where sum(amount) > 1", "where"),
    ("select amount from sales exists", "exists"), ("select zz.amount from sales", "no table"),
])
def test_refusals(tables, text, said):
    with pytest.raises(EngineError, match=said):
        run(tables, text)
