"""Manifests, panes, sources and refresh."""

from __future__ import annotations

import os
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pyspark
import pytest

from tidegraph.plans.app import AppSession, Rejected, check, explain, graph_text
from tidegraph.plans.manifest import compile_app
from tidegraph.plans.views import format_scalar
from tidegraph.sources.csv import CsvFile, CsvText, split_record
from tidegraph.sources.others import HttpCsv, JdbcQuery
from tidegraph.streaming.refresh import Refresher
from tidegraph.types import EngineError

READINGS = "reading,station,celsius,note\n" + "".join(f"{i},{'PQR'[i % 3]},{i * 0.5 - 4},{'dry' if i % 5 else 'wet'}\n" for i in range(48))
STATIONS = "station,altitude,keeper\nP,120,Ana\nQ,2210,Bo\nR,800,Cy\n"
APP = """
[app]
title = "weather"
[[source]]
name = "readings"
csv = "readings.csv"
refresh_secs = 2
[[source]]
name = "stations"
csv = "stations.csv"
[[input]]
name = "ceiling"
number = { min = 0.0, max = 9000.0, default = 9000.0 }
[[input]]
name = "keeper"
text = { default = "" }
[[cell]]
name = "located"
from = "readings"
step = [
  { join = { with = "stations", on = "station", how = "inner" } },
  { derive = { name = "fahrenheit", expr = "celsius * 1.8 + 32" } },
  { select = ["reading", "station", "altitude", "fahrenheit"] },
]
[[cell]]
name = "low"
from = "located"
step = [{ filter = { column = "altitude", op = "lt", param = "ceiling" } }]
[[cell]]
name = "warmest"
from = "low"
step = [{ sort = { column = "fahrenheit", descending = true } }, { scalar = { column = "fahrenheit" } }]
[[cell]]
name = "by_station"
sql = "select station, count(*) as n, max(fahrenheit) as top from low group by station order by station"
[[cell]]
name = "wet"
sql = "select reading, celsius from readings where note = 'wet'"
[[cell]]
name = "kept_by"
from = "stations"
step = [{ filter = { column = "keeper", op = "eq", param = "keeper", skip_when = "" } }, { count = true }]
[[pane]]
cell = "warmest"
metric = { label = "Warmest", decimals = 1, suffix = " F" }
[[pane]]
cell = "by_station"
bar = { label_column = "station", value_column = "top" }
[[pane]]
cell = "wet"
line = { x_column = "reading", y_column = "celsius" }
[[pane]]
cell = "located"
table = { max_rows = 4 }
[[pane]]
cell = "kept_by"
"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "readings.csv").write_text(READINGS)
    (tmp_path / "stations.csv").write_text(STATIONS)
    return tmp_path


def test_interactions(spark, folder):
    app = compile_app(APP, spark, str(folder))
    assert check(app) == "weather: 2 sources, 2 inputs, 6 cells, 5 panes"
    viewer = AppSession(app)
    assert viewer.trace.summary() == {"visited": 6, "evaluated": 6, "reused": 0, "changed": 6, "untouched": 4}
    assert viewer.views[0].data == {"label": "Warmest", "text": "67.1 F"}
    assert viewer.views[1].data["labels"] == ["P", "Q", "R"] and viewer.views[1].data["value_label"] == "top"
    assert viewer.views[2].data["x"] == [float(i) for i in range(0, 48, 5)] and viewer.views[2].data["y_label"] == "celsius"
    assert viewer.views[3].data["total_rows"] == 48 and len(viewer.views[3].data["rows"]) == 4
    patch = viewer.set({"ceiling": 1000.0})
    assert patch.stats == {"visited": 4, "evaluated": 3, "reused": 0, "changed": 2, "untouched": 6, "panes": 1}
    assert viewer.views[1].data["labels"] == ["P", "R"] and viewer.views[0].data["text"] == "67.1 F"
    assert viewer.set({"ceiling": 1000}).stats["visited"] == 4 or viewer.core.value("ceiling") == 1000
    assert viewer.set({"keeper": "Bo"}).stats["panes"] == 1 and viewer.views[4].data == {"text": "1"}
    assert viewer.set({"keeper": "Bo"}).stats == {"visited": 1, "evaluated": 0, "reused": 0, "changed": 0, "untouched": 9, "panes": 0}
    assert isinstance(viewer.set({"ceiling": 9500.0, "keeper": "Cy"}), Rejected) and viewer.core.value("keeper") == "Bo"
    again = AppSession(app, viewer.state())
    assert again.resumed.applied == ["ceiling", "keeper"] and again.views[4].data == {"text": "1"}
    assert AppSession(app, '{"ceiling": -1, "zz": 1}').resumed.dropped.keys() == {"ceiling", "zz"}


def test_column_grain_through_joins(spark, folder):
    """A column that moved reaches only cells that read it, on either side of a join."""
    app = compile_app(APP, spark, str(folder))
    last = lambda *change: explain(app, {}, change).split("change ")[1]
    unread = last("stations", "keeper")
    assert "reused    located" in unread and "evaluated kept_by" not in unread  # an empty keeper skips the filter
    note = last("readings", "note")
    assert "reused    located" in note and "evaluated wet" in note
    assert "evaluated located" in last("stations", "altitude") and "reused    wet" in last("readings", "station")
    for form in ("text", "mermaid", "json"):
        assert "by_station" in graph_text(app, form)


def test_cached_tables_stay_in_budget(spark, folder):
    from tidegraph.plans.cache import CacheLedger
    from tidegraph.plans.session import Session

    app = compile_app(APP, spark, str(folder))
    ledger = CacheLedger(1)
    s = Session(app.graph, ledger)
    s.refresh()
    assert ledger.names() == [] and ledger.used == 0 and s.value("located").count() == 48
    roomy = CacheLedger(1 << 30)
    s = Session(app.graph, roomy)
    s.refresh()
    held = [n for _, n in roomy.names()]
    assert set(held) == {"located", "low", "by_station", "wet"} and roomy.used > 0
    roomy.touch((id(s), held[0]))
    roomy.budget = roomy.used - 1
    assert roomy.hold("more", spark.range(10).toDF("i"))[0] == (id(s), held[1])


def test_refresh(spark, folder):
    app = compile_app(APP, spark, str(folder))
    viewer, refresher = AppSession(app), Refresher(app, spark)
    assert refresher.poll().same == ["readings", "stations"][:1] or refresher.poll().same
    (folder / "readings.csv").write_text(READINGS + "48,R,90,wet\n")
    done = refresher.poll()
    assert done.read == ["readings"]
    viewer.rebase(done.graph)
    assert viewer.core.value("warmest") == 194.0
    (folder / "readings.csv").write_text("other,columns\n1,2\n")
    failed = refresher.poll()
    assert "other columns" in failed.failed["readings"] and failed.graph is None
    assert refresher.due(0.0) == ["readings"] and refresher.due(1.0) == [] and refresher.due(2.5) == ["readings"]


@pytest.mark.parametrize(("old", "new", "said"), [
    ('csv = "readings.csv"', 'csv = "readings.csv"\nzz = 1', "no setting `zz`"), ("refresh_secs = 2", "refresh_secs = 0", "at least 1"),
    ('param = "ceiling"', 'param = "ceilin"', "did you mean `ceiling`"), ('column = "altitude"', 'column = "altitud"', "altitud"),
    ('from = "low"', 'from = "warmest"', "circle"), ("group by station", "group by statio", "statio"),
    ("bar = {", "metric = {}\nbar = {", "one of"), ('value_column = "top"', 'value_column = "station"', "no number"),
    ("metric = {", "table = {", "no setting"), ("default = 9000.0", "default = 9900.0", "default"), ("max(fahrenheit)", "median(fahrenheit)", "median"),
    ("{ count = true }", "{ count = true }, { limit = 1 }", "ended"), ('how = "inner"', 'how = "outer"', "outer"), ('on = "station"', 'on = "statio"', "statio"),
    ('csv = "readings.csv"', 'csv = "readings.csv"\nfile = { path = "a.csv" }', "exactly one"), ('[[pane]]\ncell = "wet"', '[[pane]]\ncell = "wit"', "wit"),
])
def test_manifest_errors(spark, folder, old, new, said):
    with pytest.raises(EngineError, match=said):
        compile_app(APP.replace(old, new, 1), spark, str(folder))


@pytest.mark.parametrize(("line", "fields"), [
    ('a, b ,"c ""x"" ",,d', ["a", "b", 'c "x" ', None, "d"]), ('5" pipe,3', ['5" pipe', "3"]), ('"x" y', ["x y"]), (' "a,b",c', ['"a', 'b"', "c"]),
    ('"x"y"z",1', ['xy"z"', "1"]), ('"",""""', [None, '"']), ("\ta\t,b", ["\ta\t", "b"]), (" \ta ,", ["a", None]), (",", [None, None]), ('"a', None),
    ('a,"b', None), ('"a""', None), ("x" * 9, ["x" * 9]),
])
def test_csv_records(line, fields):
    assert split_record(line) == fields


def test_csv_records_are_linear():
    import time

    began = time.perf_counter()
    assert len(split_record('"a",' * 300_000)) == 300_001
    assert time.perf_counter() - began < 5


def test_csv_dialect(spark):
    rel = CsvText('﻿a,b,c,d,e\n1,1.5,TRUE,x,\n\n +2 ,inf,false," y",\r\n').load(spark)
    assert rel.schema == [("a", "int"), ("b", "float"), ("c", "bool"), ("d", "text"), ("e", "text")]
    assert rel.head(9) == [(1, 1.5, True, "x", None), (2, float("inf"), False, " y", None)]
    assert CsvText("n\n9223372036854775808\n").load(spark).schema == [("n", "float")]
    for bad in ("a,b\n1\n", 'a\n"x\n', 't\n"a\nb"\n', "", "a,a\n1,2\n"):
        with pytest.raises(EngineError):
            CsvText(bad).load(spark).head(1)


def test_csv_file_matches_text(spark, tmp_path):
    path = tmp_path / "x.csv"
    for text in (READINGS, 'k,t\n1,5" pipe\n2,"c" d\n', "k\n\n1\n \t\n2\n", "﻿k,l\n1,2"):
        path.write_text(text)
        a, b = CsvFile(str(path)).load(spark), CsvText(text).load(spark)
        assert a.schema == b.schema and a.head(99) == b.head(99)
    with pytest.raises(EngineError):
        CsvFile(str(tmp_path / "x.txt")).load(spark)


def test_csv_folders_and_lines_of_errors(spark, tmp_path):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.csv").write_text("\n" * i + "k,v\n" + "".join(f"{10 * i + j},{i / 2}\n" for j in range(3)))
    rel = CsvFile(str(folder)).load(spark)
    assert rel.schema == [("k", "int"), ("v", "float")] and [r[0] for r in rel.head(99)] == [10 * i + j for i in range(4) for j in range(3)]
    (folder / "2.csv").write_text("k,v\n\n1,2\n3\n")
    with pytest.raises(EngineError, match=r"2.csv, line 4: 1 fields"):
        CsvFile(str(folder)).load(spark)
    (folder / "2.csv").write_text('k,v\n1,"2\n')
    with pytest.raises(EngineError, match=r"2.csv, line 2: a quoted"):
        CsvFile(str(folder)).load(spark)
    (folder / "2.csv").write_text("k,w\n1,2\n")
    with pytest.raises(EngineError, match="another header"):
        CsvFile(str(folder)).load(spark)


def test_charts_take_every_row(spark):
    from tidegraph.operators.relation import from_dataframe
    from tidegraph.plans.views import Pane, render

    rel = from_dataframe(spark.range(2000).selectExpr("id", "id * 5e-1D as half", "if(id = 7, null, id) as gap"), ["id"])
    bar = render(Pane("c", "bar", "", (("label_column", "id"), ("value_column", "half"))), rel)
    assert len(bar.data["labels"]) == 2000 and bar.data["values"][-1] == 999.5
    assert len(render(Pane("c", "line", "", (("x_column", "id"), ("y_column", "half"))), rel).data["x"]) == 2000
    with pytest.raises(EngineError, match="row 7"):
        render(Pane("c", "line", "", (("x_column", "id"), ("y_column", "gap"))), rel)
    custom = render(Pane("c", "custom", "", (("renderer", "r"), ("columns", ["half"]), ("max_rows", 3))), rel)
    assert custom.data == {"renderer": "r", "columns": ["half"], "rows": [(0.0,), (0.5,), (1.0,)], "total_rows": 2000}
    assert render(Pane("c", "text"), rel).data == {"text": "2000 rows × 3 columns"}


def test_empty_source(spark):
    from tidegraph.sources.base import EmptySource

    rel = EmptySource((("a", "int"), ("t", "text"))).load(spark)
    assert rel.schema == [("a", "int"), ("t", "text")] and rel.count() == 0


def test_http(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):  # noqa: N802
            self.send_response(405 if self.path == "/no-head.csv" else 200)
            self.send_header("ETag", "v1")
            self.end_headers()

        def do_GET(self):  # noqa: N802
            self.send_response(404 if self.path == "/gone.csv" else 200)
            self.end_headers()
            self.wfile.write(b"a,b\n1,x\n")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        source = HttpCsv(f"{base}/a.csv")
        assert source.load(spark).head(2) == [(1, "x")] and source.version(spark) == source.version(spark)
        unknown = HttpCsv(f"{base}/no-head.csv").version(spark)
        assert unknown != unknown  # noqa: PLR0124
        with pytest.raises(EngineError):
            HttpCsv(f"{base}/gone.csv").load(spark)
    finally:
        server.shutdown()


def test_jdbc_guard():
    JdbcQuery("jdbc:x", "with a as (select 1) select * from a;")
    for bad in ("delete from t", "select 1; drop table t", ""):
        with pytest.raises(EngineError):
            JdbcQuery("jdbc:x", bad)


def test_format_scalar():
    values = (None, True, 3, 3.0, 2.5, "a", [1, 2.0, None], float("nan"), float("-inf"), 1e300, 1e-7, -0.0, 1e15, 123456789012345.5)
    said = ["—", "yes", "3", "3", "2.5", "a", "1, 2, —", "NaN", "-inf", "1" + "0" * 300, "0.0000001", "-0", "1" + "0" * 15, "123456789012345.5"]
    assert [format_scalar(v) for v in values] == said


_ON_EXECUTORS = """
import sys
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").getOrCreate()
for name in ("jdbc_query", "jdbc_version"):
    print(name, [tuple(r) for r in __spark_entry__.queries()[name](spark, sys.argv[1]).collect()])
spark.stop()
"""


def test_jdbc_on_executors(spark, tmp_path):
    """Executors are processes of their own, which see no database in the driver's memory."""
    rows = [(0, "here", 0), (1, "left out", 1), (2, None, 2), (1 << 40, "it's", 3)]
    spark.createDataFrame(rows, "n_nationkey long, n_name string, n_regionkey long").coalesce(1).write.parquet(f"{tmp_path}/in/nation.parquet")
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors write below Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    kept = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env = kept | {"PYTHONPATH": str(Path(__file__).parent.parent), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    got = subprocess.run([sys.executable, "-B", "-c", _ON_EXECUTORS, f"{tmp_path}/in"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert f"jdbc_query {[rows[0], *rows[2:]]}" in got.stdout, got.stderr[-2000:]
    assert "jdbc_version [('4 1099511627776',)]" in got.stdout, got.stderr[-2000:]
