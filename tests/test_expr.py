"""Expression language: one row in, one value out."""

from __future__ import annotations

import math
import time

import pytest

from tidegraph.functions.expr import ExprError, parse
from tidegraph.operators import verbs
from tidegraph.operators.relation import from_dataframe
from tidegraph.types import EngineError, hint

MIN = -(1 << 63)
CASES = [
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("7 / 2", 3.5), ("6 / 2", 3.0), ("1 / 0", None), ("0.0 / 0.0", None),
    ("7 % 3", 1), ("-7 % 3", -1), ("7 % 0", None), ("5.5 % 2", 1.5), ("i + 9223372036854775807", None),
    ("-9223372036854775808 % -1", None), ("-(-9223372036854775808)", None), ("abs(-9223372036854775808)", None),
    ("abs(-3)", 3), ("abs(-3.5)", 3.5), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("floor(-1.5)", -2.0), ("ceil(1.2)", 2.0),
    ("floor(1e300)", 1e300), ("round(nan)", math.nan), ("min(3, 2)", 2), ("max(3, 2.5)", 3.0), ("min(1, missing)", None),
    ("min(nan, 1.0)", None), ("lower('ÀB')", "àb"), ("upper('straße')", "STRASSE"), ("trim(concat(blank, 'x', blank))", "x"),
    ("len('né')", 2), ("concat('a', 'b', 'c')", "abc"), ("concat('a', nothing)", None), ("contains('abc', 'b')", True),
    ("coalesce(missing, 4)", 4), ("coalesce(missing, 4.5)", 4.5), ("is_null(missing)", True), ("is_null(nan)", False),
    ("if(true, 1, 2.5)", 1.0), ("if(unknown, 1, 2)", None), ("if(false, 1, null)", None), ("true or unknown", None),
    ("false and unknown", None), ("not unknown", None), ("nan == nan", None), ("nan > 1.0", None), ("1 == 1.0", True),
    ("'a' < 'b'", True), ("not 1 == 2 and true", True), ("1 < 2 or unknown", None), ("`i` + 1", 2), ("'it''s'", "it's"),
    ("1e3", 1000.0), ("- 2 - -3", 1), ("2 - 3 - 4", -5), ("not true or true", True), ("$p * 2", 10),
]


@pytest.fixture(scope="module")
def row(spark):
    df = spark.sql(
        "select 1L as i, cast(null as bigint) as missing, double('nan') as nan, cast(null as boolean) as unknown, "
        "cast(null as string) as nothing, concat(char(9), '\\u00a0 ') as blank"
    )
    return from_dataframe(df)


def test_values(row):
    rel = row
    for n, (text, _) in enumerate(CASES):
        rel = verbs.derive(rel, f"x{n}", text, {"p": 5})
    got = rel.head(1)[0][len(row.fields) :]
    for (text, wanted), value in zip(CASES, got, strict=True):
        if isinstance(wanted, float) and math.isnan(wanted):
            assert math.isnan(value), text
        else:
            assert value == wanted and type(value) is type(wanted), (text, value)


@pytest.mark.parametrize("text", [
    "1 +", "1 2", "(1", "a = 1", "!true", "1 < 2 < 3", "'open", "`open", "$", "9223372036854775808", "1 + 'a'", "'a' == 1",
    "nope", "nope(1)", "len(1)", "len('a', 'b')", "if(1, 2, 3)", "if(true, 1, 'a')", "null", "coalesce(1)", "not 1", "-'a'",
    "1 and true", "2x", "# 1",
])
def test_refused(row, text):
    with pytest.raises(EngineError):
        verbs.derive(row, "x", text)


def test_caret_and_hint():
    with pytest.raises(ExprError) as problem:
        parse("1 + \n  = 2")
    assert problem.value.with_caret("1 + \n  = 2").endswith("  = 2\n    ^")
    assert hint("regoin", ["region", "units"]) == "; did you mean `region`?"
    assert "`units`" in hint("zzz", ["units"])


def test_int_arithmetic_at_the_limits(spark):
    most, root = (1 << 63) - 1, 3037000499
    values = [None, 0, 1, -1, 2, -2, 3, root, -root, root + 1, -root - 1, 1 << 32, 1 << 62, -(1 << 62), most // 2 + 1, most // 3, most // 3 + 1, most - 1, most, MIN + 1, MIN]
    pairs = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long")
    rel = from_dataframe(pairs)
    for name, expr in (("add", "a + b"), ("sub", "a - b"), ("mul", "a * b"), ("neg", "-a")):
        rel = verbs.derive(rel, name, expr)

    def fits(said):
        return said if MIN <= said <= most else None

    for a, b, *got in rel.visible().collect():
        none = a is None or b is None
        assert got == [*([None] * 3 if none else [fits(a + b), fits(a - b), fits(a * b)]), None if a is None else fits(-a)], (a, b)


def test_overflow_costs_no_more_than_a_result(spark):
    """An exception for each row that does not fit took some fifty times as long."""
    rows = from_dataframe(spark.range(0, 400_000, 1, 4).selectExpr("id as i", "id % 5 + 9223372036854775000 as k"))

    def seconds(expr):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            verbs.derive(rows, "x", expr).visible().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    for fits, over in (("(i + 2) * (i + 3)", "(i + 2) * k"), ("i + k * 0", "i + 9999 + k"), ("i - k", "-i - 9999 - k")):
        assert seconds(over) < 10 * seconds(fits) + 0.5, over


def test_long_chains_stay_small(spark):
    rel = from_dataframe(spark.createDataFrame([(1, 3)], "a long, b long"))
    rel = verbs.derive(rel, "x", " + ".join(["a * b"] * 30))
    for i in range(8):
        rel = verbs.derive(rel, f"x{i}", f"{'x' if i == 0 else f'x{i - 1}'} * 2 - b")
    assert verbs.filter_rows(rel, "x7", "gt", 0).count() == 1
