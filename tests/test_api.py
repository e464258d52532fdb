"""Real sources through the whole engine."""

from sparkloom import api
from sparkloom.__main__ import main

SOURCE = """
import os
class Shape:
  def area(self): return side(self) * 2
class Box(Shape):
  def __init__(self, n):
    self.n = n
  def area(self): return side(self) * self.n
def side(x): return x.n
def total(a, b):
  c = a.area() + b.area()
  return c
answer = total(Box(2), Box(3))
"""


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_analysis(spark):
    a = api.analyze(spark.createDataFrame([(1, "python", SOURCE), (2, "lua", "function f(n)\n  return g(n)\nend\nfunction g(n)\n  return n + 1\nend\nx = f(2)")], "program_id bigint, language string, source string"))
    funcs = {(r.program_id, r.name, r["class"]) for r in a.functions.collect()}
    assert funcs == {(1, "area", "Shape"), (1, "__init__", "Box"), (1, "area", "Box"), (1, "side", None), (1, "total", None), (2, "f", None), (2, "g", None)}
    assert {(r.func.split("_")[1], r.pos, r.param) for r in a.parameters.where("program_id = 1 and func like 'func_total%'").collect()} == {("total", 0, "a"), ("total", 1, "b")}
    name = lambda x: x.rsplit("_", 1)[0]
    calls = sorted((r.program_id, name(r.src), name(r.dst)) for r in a.call_graph.collect())
    # code behind a function's end belongs to the last function before it
    assert calls == [(1, "func_area", "func_side")] * 2 + [(1, "func_total", "func___init__")] + [(1, "func_total", "func_area")] * 2 + [(1, "func_total", "func_total"), (2, "func_f", "func_g"), (2, "func_g", "func_f")]
    assert (1, "c", "a") in rows(a.dependencies.select("program_id", "src", "dst"))
    assert a.def_use.where("program_id = 1").count() > 10
    assert a.types().where("program_id = 2 and name like '\\%%'").count() > 0


def test_replay_and_command_line(tmp_path, capsys):
    r = api.Replay("x = 1\ny = x + 2", most=50)
    assert len(r.step(3)) == 3 and r.state() == {"x": 1}
    r.run_to_end()
    assert r.state() == {"x": 1, "y": 3} and r.text()[0] == "entry:"
    assert api.run(SOURCE, most=500).frames[0].vars["answer"] == 13
    f = tmp_path / "a.py"
    f.write_text("x = 1 + 2")
    assert main([str(f), "--ir-only"]) == 0 and "store_var x" in capsys.readouterr().out
    assert main([str(f)]) == 0 and "{'x': 3}" in capsys.readouterr().out


def test_directory(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import b\nx = 1")
    (tmp_path / "b.py").write_text("y = 2")
    (tmp_path / "c.txt").write_text("no")
    files, instr = api.lower_directory(spark, str(tmp_path), "python")
    assert files.count() == 2 and instr.where("opcode = 'IMPORT_MODULE'").count() == 1


def test_summaries_and_projects(spark):
    from sparkloom import api

    a = api.analyze(spark.createDataFrame([(1, "python", "def f(x):\n  return x\ndef g(y):\n  z = f(y)\n  return z")], "program_id bigint, language string, source string"))
    assert {(r.src, r.dst_kind) for r in a.summary.collect()} == {("x", "return"), ("y", "return")}
    assert ("y", "z") in {(r.src, r.dst) for r in a.flows.collect()}
    assert {(r.func, r.callers, r.callees, r.param_to_return) for r in a.report.collect()} == {("func_f_1", 1, 0, 1), ("func_g_3", 0, 1, 1)}
    rows = [(7, 1, 0, "lib", "python", "def half(n):\n  return n // 2"), (7, 2, 1, "app", "python", "from lib import half\ndef main():\n  return half(half(40))\nanswer = half(9)")]
    r = api.run_project(spark.createDataFrame(rows, "project bigint, program_id bigint, place int, prefix string, language string, source string"), "answer", "main").collect()
    assert [tuple(x) for x in r] == [(7, "4", "10", True)]
