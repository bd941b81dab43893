"""Verbs on small tables, order included."""

from __future__ import annotations

import datetime

import pytest

from tidegraph.operators import verbs
from tidegraph.operators.relation import from_dataframe
from tidegraph.operators.verbs import Agg, JoinSpec
from tidegraph.types import EngineError

NAN = float("nan")


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("north", 10.0, 1), ("south", 30.0, 3), ("north", 5.0, None), (None, 1.0, 2)]
    return from_dataframe(spark.createDataFrame(rows, "region string, amount double, units int").coalesce(1))


@pytest.fixture(scope="module")
def regions(spark):
    rows = [("north", 3, "ana"), ("south", 5, "bo"), ("east", 2, None)]
    return from_dataframe(spark.createDataFrame(rows, "region string, head_count int, lead string").coalesce(1))


def test_types(spark, sales):
    assert sales.schema == [("region", "text"), ("amount", "float"), ("units", "int")]
    with pytest.raises(EngineError, match="`d`.*cast"):
        from_dataframe(spark.createDataFrame([(datetime.date(2026, 1, 1),)], "d date"))


@pytest.mark.parametrize(("args", "rows"), [
    (("region", "eq", "north"), 2), (("region", "ne", "north"), 1), (("units", "ge", 2), 2), (("units", "ne", 2), 2),
    (("amount", "lt", 10), 2), (("region", "contains", "ort"), 2), (("region", "ne", 5), 0), (("units", "eq", 2.0), 1),
    (("amount", "ne", NAN), 0), (("region", "eq", None), 0),
])
def test_filter(sales, args, rows):
    assert len(verbs.filter_rows(sales, *args).head(9)) == rows


def test_filter_never_matches_nan(spark):
    rel = from_dataframe(spark.createDataFrame([(NAN,), (1.0,)], "x double"))
    assert [verbs.filter_rows(rel, "x", op, 0.5).count() for op in ("gt", "ne", "lt")] == [1, 1, 0]


def test_filter_errors(sales):
    for bad in (("regin", "eq", 1), ("region", "like", "a"), ("units", "contains", "a")):
        with pytest.raises(EngineError):
            verbs.filter_rows(sales, *bad)


def test_sort_is_stable_and_keeps_nulls_last(sales):
    assert [r[0] for r in verbs.sort(sales, "region").head(9)] == ["north", "north", "south", None]
    assert [r[:2] for r in verbs.sort(sales, "region", True).head(9)] == [("south", 30.0), ("north", 10.0), ("north", 5.0), (None, 1.0)]
    assert [r[2] for r in verbs.sort(sales, "units", True).head(9)] == [3, 2, 1, None]
    twice = verbs.sort(verbs.sort(sales, "amount"), "region")
    assert [r[1] for r in twice.head(9)] == [5.0, 10.0, 30.0, 1.0]


def test_sort_text_descending_is_by_bytes(spark):
    words = ["a", "ab", "é", "", "B", "a\x01"]
    rel = verbs.sort(from_dataframe(spark.createDataFrame([(w,) for w in words], "w string")), "w", True)
    assert [r[0] for r in rel.head(9)] == sorted(words, key=str.encode, reverse=True)


def test_limit_where_it_is_written(sales):
    first = verbs.sort(verbs.limit(sales, 2), "amount", True)
    assert [r[1] for r in first.head(9)] == [30.0, 10.0]
    assert verbs.limit(sales, 0).count() == 0
    with pytest.raises(EngineError):
        verbs.limit(sales, -1)


def test_select(sales):
    assert verbs.select(sales, ["units", "region", "units"]).head(1) == [(1, "north", 1)]
    with pytest.raises(EngineError, match="did you mean `units`"):
        verbs.select(sales, ["unit"])


def test_group_by_first_appearance(sales):
    aggs = [Agg("sum", "s", "units"), Agg("count", "n"), Agg("min", "low", "amount"), Agg("mean", "m", "amount")]
    assert verbs.group_by(sales, ["region"], aggs).head(9) == [("north", 1.0, 2, 5.0, 7.5), ("south", 3.0, 1, 30.0, 30.0), (None, 2.0, 1, 1.0, 1.0)]
    turned = verbs.group_by(verbs.sort(sales, "amount", True), ["region"], [Agg("count", "n")])
    assert [r[0] for r in turned.head(9)] == ["south", "north", None]


def test_group_without_keys_or_rows(sales):
    none = verbs.filter_rows(sales, "amount", "gt", 1e9)
    assert verbs.group_by(none, [], [Agg("count", "n"), Agg("sum", "s", "units")]).head(9) == [(0, None)]
    assert verbs.group_by(none, ["region"], [Agg("count", "n")]).head(9) == []
    assert verbs.group_by(sales, ["region"], []).head(9) == [("north",), ("south",), (None,)]


def test_group_errors(sales):
    for aggs in ([Agg("sum", "s", "region")], [Agg("count", "region")], [Agg("median", "m", "units")], [Agg("sum", "s")], [Agg("sum", "s", "zz")]):
        with pytest.raises(EngineError):
            verbs.group_by(sales, ["region"], aggs)


def test_max_ignores_nan_unless_all_are(spark):
    rel = from_dataframe(spark.createDataFrame([("a", NAN), ("a", 1.0), ("b", NAN), ("c", None)], "k string, x double").coalesce(1))
    got = verbs.group_by(rel, ["k"], [Agg("max", "m", "x"), Agg("min", "n", "x")]).head(9)
    assert got[0][1:] == (1.0, 1.0) and got[1][1] != got[1][1] and got[2][1:] == (None, None)


@pytest.mark.parametrize(("how", "rows"), [
    ("inner", [("north", 3), ("south", 5), ("north", 3)]), ("left", [("north", 3), ("south", 5), ("north", 3), (None, None)]),
    ("semi", [("north", 10.0), ("south", 30.0), ("north", 5.0)]), ("anti", [(None, 1.0)]),
])
def test_join(sales, regions, how, rows):
    got = verbs.join(sales, regions, JoinSpec(("region",), ("region",), how)).head(9)
    at = 3 if how in ("inner", "left") else 1
    assert [(r[0], r[at]) for r in got] == rows


def test_join_multiplicity(sales, regions):
    once = JoinSpec(("region",), ("region",), "left", "_s")
    with pytest.raises(EngineError, match="2 rows with region = 'north'"):
        verbs.join(regions, sales, once)
    many = verbs.join(regions, sales, JoinSpec(("region",), ("region",), "left", "", True)).head(9)
    assert [(r[0], r[3]) for r in many] == [("north", 10.0), ("north", 5.0), ("south", 30.0), ("east", None)]


def test_join_schema_errors(sales, regions):
    for spec in (
        JoinSpec(("units",), ("region",), "inner"), JoinSpec(("region",), ("lead", "region"), "inner"), JoinSpec(("regoin",), ("region",), "inner"),
        JoinSpec(("region",), ("region",), "outer"), JoinSpec(("region",), ("region",), "semi", "_r"),
    ):
        with pytest.raises(EngineError):
            verbs.join(sales, regions, spec)
    with pytest.raises(EngineError, match="suffix"):
        verbs.join(regions, regions, JoinSpec(("region",), ("region",), "inner"))


def test_scalar_and_count(sales):
    assert verbs.scalar(sales, "amount", 1) == 30.0
    assert verbs.scalar(sales, "amount", 9) is None
    assert verbs.count(sales) == 4


def test_partitions_do_not_matter(spark):
    rows = [(i % 7, float(i)) for i in range(200)]
    one, many = (from_dataframe(spark.createDataFrame(rows, "k int, v double").repartition(n, "k"), ["v"]) for n in (1, 5))
    for rel in (one, many):
        got = verbs.group_by(verbs.sort(rel, "v", True), ["k"], [Agg("count", "n")]).head(9)
        assert [r[0] for r in got] == [3, 2, 1, 0, 6, 5, 4]
