"""Graph, sessions, lineage and a randomized comparison with full recomputation."""

from __future__ import annotations

import random

import pytest

from tidegraph.operators.relation import from_dataframe
from tidegraph.plans.graph import Cell, Graph, Source
from tidegraph.plans.session import Failure, Session
from tidegraph.types import EngineError


def add(name, *inputs, runs=None):
    def compute(values):
        if runs is not None:
            runs.append(name)
        return sum(values.values())

    return Cell(name, inputs, compute)


def test_graph_errors():
    for cells in ([add("a", "b"), add("b", "a")], [add("a", "nope")], [add("x", "x0"), add("x", "x0")]):
        with pytest.raises(EngineError):
            Graph([Source("x0", 1)], cells)


def test_diamond_runs_each_cell_once():
    runs = []
    s = Session(Graph([Source("x", 1)], [add("d", "b", "c", runs=runs), add("b", "x", runs=runs), add("c", "x", runs=runs)]))
    s.refresh()
    assert sorted(runs) == ["b", "c", "d"] and runs[-1] == "d" and s.value("d") == 2
    runs.clear()
    s.set("x", 3)
    s.set("x", 5)
    trace = s.commit()
    assert s.value("d") == 10 and trace.evaluated == 3 and len(runs) == 3
    s.set("x", 5)
    assert s.commit().steps[0].changed is False and len(runs) == 3


def test_equal_value_stops_the_wave():
    runs = []
    parity = Cell("p", ("x",), lambda v: v["x"] % 2)
    s = Session(Graph([Source("x", 1)], [parity, add("after", "p", runs=runs)]))
    s.refresh()
    s.set("x", 3)
    assert s.commit().summary() == {"visited": 3, "evaluated": 1, "reused": 1, "changed": 0, "untouched": 0}
    assert runs == ["after"] and s.changed_since(1) == ["x"]


def test_set_is_typed():
    s = Session(Graph([Source("x", 1.5, "float"), Source("t", "a")], [add("y", "x")]))
    s.set("x", 2)
    for name, value in (("x", "a"), ("x", True), ("t", 1), ("y", 1), ("zz", 1)):
        with pytest.raises(EngineError):
            s.set(name, value)


def test_errors_are_values_and_heal():
    s = Session(Graph([Source("x", 0)], [Cell("inv", ("x",), lambda v: 1 // v["x"]), add("after", "inv")]))
    s.refresh()
    assert isinstance(s.value("after"), Failure) and s.value("after").origin == "inv"
    s.set("x", 1)
    s.commit()
    assert s.value("after") == 1


def test_rebase_keeps_what_a_viewer_set():
    g = Graph([Source("x", 1), Source("y", 1)], [add("z", "x", "y")])
    s = Session(g)
    s.refresh()
    s.set("x", 10)
    s.commit()
    assert g.with_sources({"x": 1}) is None
    s.rebase(g.with_sources({"x": 2, "y": 5}))
    assert s.value("z") == 15


def test_placement():
    page = Cell("p", ("a",), lambda v: 0, place="page")
    g = Graph([Source("x", 1)], [add("a", "x"), page])
    assert g.split() == (["a"], ["p"]) and g.frontier() == ["a"]
    with pytest.raises(EngineError, match="page"):
        Graph([Source("x", 1)], [add("a", "x"), page, add("b", "p")]).split()


@pytest.mark.parametrize("seed", range(40))
def test_random_graphs_agree_with_recomputation(seed):
    r = random.Random(seed)
    names, cells = ["s0", "s1", "s2"], []
    ops = [sum, max, lambda v: sum(v) % 2, lambda v: 7, lambda v: 100 // (v[0] % 4)]
    for i in range(r.randint(3, 9)):
        inputs = tuple(r.sample(names, r.randint(1, min(3, len(names)))))
        op = r.choice(ops)
        cells.append(Cell(f"c{i}", inputs, lambda v, op=op: op(list(v.values()))))
        names.append(f"c{i}")
    s = Session(Graph([Source(f"s{i}", r.randint(0, 5)) for i in range(3)], cells))
    s.refresh()
    for _ in range(12):
        for n in r.sample(["s0", "s1", "s2"], r.randint(1, 2)):
            s.set(n, r.randint(0, 5))
        s.commit()
        fresh = Session(Graph([Source(n, s.value(n)) for n in ("s0", "s1", "s2")], cells))
        fresh.refresh()
        assert all(s.value(c.name) == fresh.value(c.name) for c in cells)


def test_table_digests_follow_content_and_order(spark):
    from tidegraph.operators import verbs
    from tidegraph.plans.digest import of_relation

    rows = [(i, float(i % 3), str(i)) for i in range(50)]
    a, b = (from_dataframe(spark.createDataFrame(rows, "k int, v double, t string").repartition(n, "k"), ["k"]) for n in (1, 3))
    assert of_relation(a) == of_relation(b)
    turned = verbs.sort(a, "k", True)
    assert of_relation(turned).whole != of_relation(a).whole and of_relation(turned).shape == of_relation(a).shape
    other = verbs.select(verbs.derive(a, "w", "if(k == 7, -0.0, v)"), ["k", "w"])
    assert of_relation(other).column("k") == of_relation(a).column("k")
