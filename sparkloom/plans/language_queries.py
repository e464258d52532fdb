"""Registered queries of operators, types, linking, sources, the machine and streaming, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import operators as O
from sparkloom.operators import types as Y
from sparkloom.plans import fixpoint
from sparkloom.plans.schema import TYPES, type_dim, values_sql
from sparkloom.sources import imports as S
from sparkloom.streaming import sessions
from sparkloom.vm import tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# operators
@query("ro01_binary_operators", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, a + b AS add_, a - b AS sub_, a * b AS mul_, CASE WHEN b <> 0 THEN CAST(floor(a / CAST(b AS DOUBLE) * 1000 + 0.5) AS BIGINT) END AS div_, CASE WHEN b <> 0 THEN CAST(floor(a / CAST(b AS DOUBLE)) AS BIGINT) END AS floor_,
  CASE WHEN b <> 0 THEN CAST(a - b * floor(a / CAST(b AS DOUBLE)) AS BIGINT) END AS mod_, CAST(pow(b, 3) AS BIGINT) AS pow_, a IS NOT DISTINCT FROM b AS eq_, a IS DISTINCT FROM b AS ne_, a < b AS lt_, a >= b AS ge_,
  CASE WHEN a <> 0 THEN b ELSE a END AS and_, CASE WHEN a <> 0 THEN a ELSE b END AS or_, a & 255 AS band_, a | 255 AS bor_, xor(a, 255) AS xor_, a * 8 AS shl_, abs(a) // 4 AS shr_, CAST(a AS VARCHAR) || CAST(b AS VARCHAR) AS concat_, coalesce(n, b) AS nullish_, list_contains([b, 1, 2], a) AS in_
FROM (SELECT *, l_partkey - 100 AS a, l_suppkey % 7 - 3 AS b, CASE WHEN l_linenumber > 3 THEN l_partkey END AS n FROM lineitem)""")
def binary_operators(spark, sf):
    t = table(spark, sf, "lineitem").withColumns({"a": F.col("l_partkey") - 100, "b": F.col("l_suppkey") % 7 - 3, "n": F.when(F.col("l_linenumber") > 3, F.col("l_partkey"))})
    a, b, op = F.col("a"), F.col("b"), O.BINARY
    return t.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", op["+"](a, b).alias("add_"), op["-"](a, b).alias("sub_"), op["*"](a, b).alias("mul_"), F.floor(op["/"](a, b) * 1000 + 0.5).cast("bigint").alias("div_"), op["//"](a, b).alias("floor_"),
        op["%"](a, b).alias("mod_"), op["**"](b, F.lit(3)).cast("bigint").alias("pow_"), op["=="](a, b).alias("eq_"), op["!="](a, b).alias("ne_"), op["<"](a, b).alias("lt_"), op[">="](a, b).alias("ge_"),
        op["and"](a, b).alias("and_"), op["or"](a, b).alias("or_"), op["&"](a, F.lit(255)).alias("band_"), op["|"](a, F.lit(255)).alias("bor_"), op["^"](a, F.lit(255)).alias("xor_"), op["<<"](a, F.lit(3)).alias("shl_"), op[">>"](F.abs(a), F.lit(2)).alias("shr_"),
        op[".."](a, b).alias("concat_"), op["??"](F.col("n"), b).alias("nullish_"), op["in"](a, F.array(b, F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("in_"),
    )


@query("ro36_unary_operators", "SELECT p_partkey, -p_size AS neg, p_size AS pos, p_size = 0 AS not_, -p_size - 1 AS inv, length(p_name) AS len, p_size AS same FROM part")
def unary_operators(spark, sf):
    n, op = F.col("p_size"), O.UNARY
    return table(spark, sf, "part").select("p_partkey", op["-"](n).alias("neg"), op["+"](n).alias("pos"), op["not"](n).alias("not_"), op["~"](n).alias("inv"), op["#"](F.col("p_name")).alias("len"), op["!!"](n).alias("same"))


# types
_TYPES = f"t AS (SELECT name, parent FROM {values_sql(TYPES, 'name, parent')}), up AS (SELECT name, name AS ancestor, 0 AS depth FROM t UNION SELECT u.name, t.parent, u.depth + 1 FROM up u JOIN t ON t.name = u.ancestor WHERE t.parent <> '')"


@query("rt07_subtypes", f"WITH RECURSIVE {_TYPES} SELECT name, ancestor, min(depth) AS depth FROM up GROUP BY name, ancestor")
def subtypes(spark, sf):
    return Y.ancestors(type_dim(spark))


@query("rt09_least_upper_bounds", f"""WITH RECURSIVE {_TYPES}
SELECT p.a, p.b, CASE WHEN p.a = p.b THEN p.a ELSE coalesce(min_by(u.ancestor, u.depth), 'Any') END AS lub FROM (SELECT x.name AS a, y.name AS b FROM t x, t y) p
LEFT JOIN up u ON u.name = p.a AND EXISTS (SELECT 1 FROM up v WHERE v.name = p.b AND v.ancestor = u.ancestor) GROUP BY p.a, p.b""")
def upper_bounds(spark, sf):
    names = [n for n, _ in TYPES]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    return Y.least_upper_bounds(Y.ancestors(type_dim(spark)), pairs)


@query("rt11_extended_lattice", f"WITH RECURSIVE {_TYPES.replace('t AS (SELECT name, parent FROM', 't AS (SELECT * FROM (VALUES (' + chr(39) + 'Cat' + chr(39) + ', ' + chr(39) + 'Object' + chr(39) + '), (' + chr(39) + 'Cat' + chr(39) + ', ' + chr(39) + 'Number' + chr(39) + ')) x(name, parent) UNION ALL SELECT name, parent FROM')} SELECT name, ancestor, min(depth) AS depth FROM up WHERE name = 'Cat' GROUP BY name, ancestor")
def extended_lattice(spark, sf):
    """A type with a class and an interface above it."""
    more = spark.createDataFrame([("Cat", "Object"), ("Cat", "Number")], "name string, parent string")
    return Y.ancestors(type_dim(spark).union(more)).where("name = 'Cat'")


@query("rt08_structural_types", "SELECT * FROM (VALUES ('Array[Int]', 'Array[Number]', TRUE, 'Array[Number]'), ('Int', 'Union[Int, String]', TRUE, 'Union[Int, String]'), ('Union[Int, Bool]', 'Int', FALSE, 'Union[Bool, Int]'), ('Fn(Number) -> Int', 'Fn(Int) -> Number', TRUE, 'Fn(Int) -> Number'), ('Array[Int]', 'Object', TRUE, 'Object'), ('Map[String, Int]', 'Map[String, Float]', FALSE, 'Map[String, Number]'), ('Optional[Int]', 'Int', FALSE, 'Union[Int, Null]')) v(a, b, below, lub)")
def structural_types(spark, sf):
    rows = [("Array[Int]", "Array[Number]"), ("Int", "Union[Int, String]"), ("Union[Int, Bool]", "Int"), ("Fn(Number) -> Int", "Fn(Int) -> Number"), ("Array[Int]", "Object"), ("Map[String, Int]", "Map[String, Float]"), ("Optional[Int]", "Int")]
    return spark.createDataFrame(rows, "a string, b string").withColumn("c", Y.compare("a", "b")).select("a", "b", "c.below", "c.lub")


_KINDS = "CASE p_size % 4 WHEN 0 THEN 'Int' WHEN 1 THEN 'Float' WHEN 2 THEN 'Bool' ELSE 'String' END"


def _kind(n):
    return F.when(n % 4 == 0, "Int").when(n % 4 == 1, "Float").when(n % 4 == 2, "Bool").otherwise("String")


@query("rt12_binop_types", f"""SELECT op, a, b, count(*) AS n, CASE WHEN op = '<' THEN 'Bool' WHEN a <> 'String' AND b <> 'String' THEN CASE WHEN a = 'Float' OR b = 'Float' THEN 'Float' ELSE 'Int' END WHEN op = '+' THEN 'String' ELSE 'Unknown' END AS result
FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '/' ELSE '<' END AS op, {_KINDS} AS a, {_KINDS.replace('p_size', '(p_partkey // 7)')} AS b FROM part) GROUP BY op, a, b""")
def binop_types(spark, sf):
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select(F.when(k % 3 == 0, "+").when(k % 3 == 1, "/").otherwise("<").alias("op"), _kind(F.col("p_size")).alias("a"), _kind(F.floor(k / 7)).alias("b"))
    t = t.groupBy("op", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("result", Y.binop_type(F.col("op"), F.col("a"), F.col("b")))


@query("rt13_coercions", "SELECT o_orderkey, CAST(trunc(-o_totalprice) AS BIGINT) AS int_of_float, CAST(o_orderkey AS DOUBLE) AS float_of_int, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS int_of_bool, 'is ' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS joined FROM orders")
def coercions(spark, sf):
    t = table(spark, sf, "orders")
    f = F.col("o_orderstatus") == "F"
    return t.select("o_orderkey", Y.assign(-F.col("o_totalprice"), "Float", "Int").alias("int_of_float"), Y.assign(F.col("o_orderkey"), "Int", "Float").alias("float_of_int"), Y.assign(f, "Bool", "Int").alias("int_of_bool"), F.concat(F.lit("is "), Y.stringify(f, "Bool")).alias("joined"))


_OVERLOADS = [(0, 1, "Int"), (1, 1, "Number"), (2, 2, "Int"), (3, 1, "String")]


@query("ra13_overload_ranking", f"""WITH o AS (SELECT * FROM {values_sql(_OVERLOADS, 'ord, n_params, want')}), c AS (
  SELECT p_partkey, ord, n_params, 1 + p_partkey % 2 AS n_args, CASE WHEN have = want THEN 2 WHEN have || '>' || want IN ('Int>Float', 'Float>Int', 'Bool>Int', 'Bool>Float') OR (have IN ('Int', 'Float') AND want = 'Number') THEN 1 ELSE -1 END AS score
  FROM (SELECT p_partkey, {_KINDS} AS have FROM part), o)
SELECT p_partkey, ord AS chosen, score, 4 AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(n_params - n_args), score DESC, ord) AS r FROM c) WHERE r = 1""")
def overload_ranking(spark, sf):
    calls = table(spark, sf, "part").select("p_partkey", (1 + F.col("p_partkey") % 2).alias("n_args"), _kind(F.col("p_size")).alias("have"))
    over = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("n_params"), F.lit(w).alias("want")) for o, n, w in _OVERLOADS])
    c = calls.select("*", F.inline(over))
    below = F.broadcast(Y.ancestors(type_dim(spark)).select(F.col("name").alias("have"), F.col("ancestor").alias("want"), F.lit(True).alias("below")))
    c = c.join(below, ["have", "want"], "left").withColumn("score", Y.score(F.col("have"), F.col("want"), F.coalesce("below", F.lit(False))))
    return Y.rank_overloads(c, ["p_partkey"]).where("rank = 1").select("p_partkey", F.col("ord").alias("chosen"), "score", F.col("n_candidates").alias("candidates"))


# graphs of modules
_MODULES = "e AS (SELECT DISTINCT p_partkey AS src, p_partkey // d AS dst FROM part, (VALUES (2), (3)) x(d) WHERE p_partkey > 0)"


def _module_edges(spark, sf):
    p = table(spark, sf, "part").where("p_partkey > 0")
    return p.select(F.col("p_partkey").alias("src"), F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3))).alias("dst")).distinct()


@query("rg15_topological_levels", f"WITH RECURSIVE {_MODULES}, lv AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS level UNION SELECT e.src, lv.level + 1 FROM lv JOIN e ON e.dst = lv.node) SELECT node, max(level) AS level FROM lv GROUP BY node")
def topological_levels(spark, sf):
    e = _module_edges(spark, sf)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return fixpoint.levels(nodes, e)


@query("rg17_reachable_modules", f"WITH RECURSIVE {_MODULES}, r AS (SELECT CAST(150 AS BIGINT) AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def reachable_modules(spark, sf):
    seeds = spark.createDataFrame([(0, 150)], "k int, node bigint")
    return fixpoint.reach(seeds, _module_edges(spark, sf).withColumn("k", F.lit(0)), ["k"]).select("node")


@query("rg18_method_resolution", f"WITH RECURSIVE {_MODULES}, r AS (SELECT DISTINCT src AS class, dst AS parent, 1 AS depth FROM e UNION SELECT r.class, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.parent) SELECT class, parent, min(depth) AS depth FROM r GROUP BY class, parent")
def method_resolution(spark, sf):
    """Each class's parents, nearest first.

    No side of a join is broadcast, however small it is guessed: a table of edges that is a few megabytes in a file fills the driver.
    """
    e = fixpoint.settled(_module_edges(spark, sf))
    out, new, depth = None, e.select(F.col("src").alias("class"), F.col("dst").alias("node")), 1
    while True:
        new = fixpoint.settled(new)
        if new.isEmpty():
            return (new.withColumn("depth", F.lit(depth)) if out is None else out).select("class", F.col("node").alias("parent"), "depth")
        found = new.withColumn("depth", F.lit(depth))
        out = found if out is None else out.union(found)
        hop = new.join(e.hint("merge"), F.col("node") == F.col("src")).select("class", F.col("dst").alias("node")).distinct()
        new, depth = hop.join(out.select("class", "node").hint("merge"), ["class", "node"], "left_anti"), depth + 1


_FILES = ["app/main.py", "app/util.py", "lib/core/__init__.py", "web/index.js", "web/lib/a.ts", "src/main/java/com/x/Y.java", "src/io.rs", "include/stdio_own.h", "cpy/CUSTREC.cpy", "pkg/mod.lua", "app/setup.cfg", "lib/core/pyproject.toml"]
_IMPORTS = [("python", "app", "util"), ("python", "", "lib.core"), ("python", "app", "os"), ("javascript", "web", "./lib/a"), ("java", "", "com.x.Y"), ("rust", "", "io"), ("c", "src", "stdio_own.h"), ("cobol", "", "CUSTREC"), ("lua", "", "pkg.mod"), ("javascript", "web", "react")]
_FOUND = ["app/util.py", "lib/core/__init__.py", None, "web/lib/a.ts", "src/main/java/com/x/Y.java", "src/io.rs", "include/stdio_own.h", "cpy/CUSTREC.cpy", "pkg/mod.lua", None]


@query("rl09_import_resolution", "SELECT * FROM " + values_sql([(*i, p) for i, p in zip(_IMPORTS, _FOUND)], "language, dir, module, path"))
def import_resolution(spark, sf):
    return S.resolve(spark.createDataFrame(_IMPORTS, "language string, dir string, module string"), spark.createDataFrame([(f,) for f in _FILES], "path string"))


@query("rl10_project_roots", "SELECT * FROM " + values_sql([("app/main.py", "app"), ("lib/core/__init__.py", "lib/core"), ("web/index.js", None)], "path, root"))
def project_roots(spark, sf):
    return S.project_roots(spark.createDataFrame([("app/main.py",), ("lib/core/__init__.py",), ("web/index.js",)], "path string"), spark.createDataFrame([("app/setup.cfg",), ("lib/core/pyproject.toml",)], "path string"))


_SOURCES = [
    ("p1", "python", "import os\nfrom a.b import c\nx = 1"), ("p2", "javascript", "import x from './m';\nconst y = require('z');"), ("p3", "java", "import java.util.List;\nimport static a.B.c;"),
    ("p4", "go", 'import "fmt"'), ("p5", "rust", "use std::io;\nmod own;"), ("p6", "c", '#include <stdio.h>\n#include "own.h"'), ("p7", "csharp", "using System.Text;"), ("p8", "kotlin", "import a.b.C"),
    ("p9", "scala", "import a.b.C"), ("p10", "ruby", "require 'json'\nrequire_relative 'own'"), ("p11", "php", "<?php require_once('a.php');"), ("p12", "lua", "local m = require('pkg.mod')"), ("p13", "pascal", "uses SysUtils;"), ("p14", "cobol", "       COPY CUSTREC.\n           CALL 'SUB1'."),
]
_NAMES = [("p1", "os"), ("p1", "a.b"), ("p2", "./m"), ("p2", "z"), ("p3", "java.util.List"), ("p3", "a.B.c"), ("p4", "fmt"), ("p5", "std::io"), ("p5", "own"), ("p6", "stdio.h"), ("p6", "own.h"), ("p7", "System.Text"), ("p8", "a.b.C"), ("p9", "a.b.C"), ("p10", "json"), ("p10", "own"), ("p11", "a.php"), ("p12", "pkg.mod"), ("p13", "SysUtils"), ("p14", "CUSTREC"), ("p14", "SUB1")]


@query("rs05_language_imports", "SELECT * FROM " + values_sql(_NAMES, "program_id, module"))
def language_imports(spark, sf):
    return S.extract(spark.createDataFrame(_SOURCES, "program_id string, language string, source string")).select("program_id", "module")


# the machine
#: Programs with their answers: what each language feature must give.
GOLDEN = {
    "factorial": ("def f(n):\n  r = 1\n  while n > 1:\n    r = r * n\n    n = n - 1\n  return r\nanswer = f(5)", 120),
    "fibonacci": ("def fib(n):\n  return n if n < 2 else fib(n - 1) + fib(n - 2)\nanswer = fib(10)", 55),
    "gcd": ("def gcd(a, b):\n  while b: a, b = b, a % b\n  return a\nanswer = gcd(48, 18)", 6),
    "double_add": ("def twice(x): return x * 2\ndef add(a, b): return twice(a) + twice(b)\nanswer = add(3, 4)", 14),
    "closure": ("def make(n):\n  def add(x): return x + n\n  return add\nanswer = make(10)(5)", 15),
    "ackermann": ("def ack(m, n):\n  if m == 0: return n + 1\n  if n == 0: return ack(m - 1, 1)\n  return ack(m - 1, ack(m, n - 1))\nanswer = ack(2, 3)", 9),
    "linked_list": ("class Node:\n  def __init__(self, v, n):\n    self.v = v\n    self.n = n\nh = Node(1, Node(2, Node(3, None)))\nanswer = 0\nwhile h is not None:\n  answer += h.v\n  h = h.n", 6),
    "ternary": ("x = -5\nanswer = -x if x < 0 else x", 5),
    "bits": ("answer = (12 & 10) ^ 5", 13),
    "accumulate": ("answer = sum([x for x in range(1, 6)])", 15),
    "nested_loops": ("answer = 0\nfor i in range(3):\n  for j in range(2):\n    answer += 1", 6),
    "exceptions": ("def g():\n  raise 7\ntry:\n  g()\n  answer = 1\nexcept E as e:\n  answer = e", 7),
    "inheritance": ("class A:\n  def f(self): return 4\nclass B(A):\n  pass\nanswer = B().f()", 4),
    "defaults": ("def f(a, b=3): return a * b\nanswer = f(2) + f(2, 5)", 16),
    "spread": ("def f(a, b, c): return a * 100 + b * 10 + c\nxs = [1, 2, 3]\nanswer = f(*xs)", 123),
    "dictionary": ("d = {'a': 1, 'b': 2}\nd['c'] = d['a'] + d['b']\nanswer = d['c']", 3),
    "grains": ("answer = 2 ** 63", 2**63),
}


def _programs(spark):
    return spark.createDataFrame([(k, "python", s) for k, (s, _) in GOLDEN.items()], "name string, language string, source string")


@query("rs03_lowered_opcodes")
def lowered(spark, sf):
    tables.register(spark)
    _programs(spark).createOrReplaceTempView("sparkloom_programs")
    return spark.sql("SELECT name, opcode, count(*) AS n FROM sparkloom_programs p, LATERAL lower_source(p.source, p.language) GROUP BY name, opcode")


@query("rm03_golden_answers", "SELECT * FROM " + values_sql([(k, json.dumps(a)) for k, (_, a) in GOLDEN.items()], "name, answer"))
def golden_answers(spark, sf):
    tables.register(spark)
    _programs(spark).createOrReplaceTempView("sparkloom_programs")
    return spark.sql("SELECT name, r.answer FROM sparkloom_programs p, LATERAL run_source(p.source, p.language, 'answer', 20000) r")


@query("rm04_execution_trace", "SELECT 'bits' AS name, step, opcode FROM (VALUES (1, 'LABEL'), (2, 'CONST'), (3, 'CONST'), (4, 'BINOP'), (5, 'CONST'), (6, 'BINOP'), (7, 'STORE_VAR')) v(step, opcode)")
def execution_trace(spark, sf):
    tables.register(spark)
    _programs(spark).where("name = 'bits'").createOrReplaceTempView("sparkloom_bits")
    return spark.sql("SELECT name, t.step, t.opcode FROM sparkloom_bits p, LATERAL trace_source(p.source, 100) t")


@query("rm04_traced_answers", "SELECT * FROM " + values_sql([(k, json.dumps(a)) for k, (_, a) in GOLDEN.items()], "name, answer"))
def traced_answers(spark, sf):
    """Every program's last traced value of its answer."""
    tables.register(spark)
    _programs(spark).createOrReplaceTempView("sparkloom_programs")
    t = spark.sql("SELECT name, t.step, t.variables['answer'] AS answer FROM sparkloom_programs p, LATERAL trace_source(p.source, 20000) t")
    return t.groupBy("name").agg(F.max_by("answer", "step").alias("answer"))


#: The same function in every language.
FACTORIALS = {
    "python": 'def f(n):\n  return 1 if n < 2 else n * f(n - 1)\nanswer = f(5)',
    "javascript": 'function f(n) {\n  let r = 1;\n  while (n > 1) { r = r * n; n = n - 1; }\n  return r;\n}\nlet answer = f(5);',
    "typescript": 'function f(n: number): number {\n  let r: number = 1;\n  for (let i = 2; i <= n; i++) { r *= i; }\n  return r;\n}\nconst answer: number = f(5);',
    "java": 'static int f(int n) {\n  int r = 1;\n  for (int i = 1; i <= n; i++) r = r * i;\n  return r;\n}\nint answer = f(5);',
    "c": '#include <stdio.h>\nint f(int n) {\n  if (n <= 1) return 1;\n  return n * f(n - 1);\n}\nint answer = f(5);',
    "cpp": 'int f(int n) { return n <= 1 ? 1 : n * f(n - 1); }\nint answer = f(5);',
    "csharp": 'using System;\npublic static int f(int n) { int r = 1; while (n > 1) { r *= n; n--; } return r; }\nint answer = f(5);',
    "go": 'package main\nfunc f(n int) int {\n  r := 1\n  for i := 2; i <= n; i++ {\n    r = r * i\n  }\n  return r\n}\nanswer := f(5)',
    "rust": 'fn f(n: i32) -> i32 {\n  let mut r: i32 = 1;\n  let mut i = n;\n  while i > 1 { r = r * i; i = i - 1; }\n  r\n}\nlet answer = f(5);',
    "kotlin": 'fun f(n: Int): Int {\n  var r = 1\n  var i = n\n  while (i > 1) { r *= i; i -= 1 }\n  return r\n}\nval answer = f(5)',
    "scala": 'def f(n: Int): Int = {\n  if (n <= 1) { return 1 }\n  n * f(n - 1)\n}\nval answer = f(5)',
    "php": '<?php\nfunction f($n) { $r = 1; while ($n > 1) { $r = $r * $n; $n--; } return $r; }\n$answer = f(5);',
    "lua": 'function f(n)\n  if n <= 1 then\n    return 1\n  else\n    return n * f(n - 1)\n  end\nend\nanswer = f(5)',
    "ruby": 'def f(n)\n  r = 1\n  while n > 1\n    r = r * n\n    n -= 1\n  end\n  r\nend\nanswer = f(5)',
    "pascal": 'function f(n: integer): integer;\nvar i: integer;\nbegin\n  f := 1;\n  for i := 2 to n do\n  begin\n    f := f * i;\n  end;\nend;\nbegin\n  answer := f(5);\nend.',
    "cobol": '       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 N PIC 9(4) VALUE 5.\n       01 ANSWER PIC 9(6) VALUE 1.\n       PROCEDURE DIVISION.\n       MAIN-PARA.\n           PERFORM STEP-PARA UNTIL N < 2.\n           STOP RUN.\n       STEP-PARA.\n           MULTIPLY N BY ANSWER.\n           SUBTRACT 1 FROM N.\n',
}


@query("rf01_factorial_in_every_language", "SELECT * FROM " + values_sql([(k, "120") for k in FACTORIALS], "language, answer"))
def factorials(spark, sf):
    tables.register(spark)
    rows = [(k, s, "ANSWER" if k == "cobol" else "answer") for k, s in FACTORIALS.items()]
    spark.createDataFrame(rows, "language string, source string, variable string").createOrReplaceTempView("sparkloom_languages")
    return spark.sql("SELECT language, r.answer FROM sparkloom_languages p, LATERAL run_source(p.source, p.language, p.variable, 5000) r")


@query("ra05_language_shapes")
def language_shapes(spark, sf):
    """Languages whose lowering of one function has the same number of blocks and edges, the largest class first."""
    from sparkloom.operators import cfg

    tables.register(spark)
    spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(FACTORIALS.items())], "program_id bigint, language string, source string").createOrReplaceTempView("sparkloom_shapes")
    instr = spark.sql("SELECT program_id, language, r.* FROM sparkloom_shapes p, LATERAL lower_source(p.source, p.language) r")
    b = cfg.blocks(cfg.placed(instr.drop("language")))
    shape = b.groupBy("program_id").agg(F.count(F.lit(1)).alias("blocks")).join(cfg.edges(b).groupBy("program_id").agg(F.count(F.lit(1)).alias("edges")), "program_id", "left")
    named = shape.join(instr.select("program_id", "language").distinct(), "program_id")
    classes = named.groupBy("blocks", "edges").agg(F.array_join(F.array_sort(F.collect_list("language")), ", ").alias("languages"), F.count(F.lit(1)).alias("n"))
    return classes.withColumn("class", F.dense_rank().over(Window.orderBy(F.desc("n"), "blocks", "edges")))


@query("ra10_required_opcodes")
def required_opcodes(spark, sf):
    """Opcodes that every language's lowering has."""
    tables.register(spark)
    spark.createDataFrame(list(FACTORIALS.items()), "language string, source string").createOrReplaceTempView("sparkloom_opcodes")
    i = spark.sql("SELECT DISTINCT language, r.opcode FROM sparkloom_opcodes p, LATERAL lower_source(p.source, p.language) r")
    return i.groupBy("opcode").agg(F.count(F.lit(1)).alias("languages")).where(F.col("languages") == len(FACTORIALS)).select("opcode")


_GCD = "def gcd(a, b):\n  while b: a, b = b, a % b\n  return a\nanswer = gcd(x, y)"


@query("rv09_calls_over_rows", "SELECT p_partkey, CAST(CASE WHEN p_partkey = 0 THEN p_size ELSE gcd(p_partkey, p_size) END AS VARCHAR) AS answer FROM part")
def calls_over_rows(spark, sf):
    """One run of a program for each row of a table."""
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_partkey").alias("x"), F.col("p_size").cast("bigint").alias("y"))
    return tables.run_over(rows, _GCD, ["x", "y"], "answer").select("p_partkey", "answer")


_COLLATZ = "n = x % 50 + 1\nk = 0\nwhile n != 1:\n  if n % 2 == 0: n = n // 2\n  else: n = 3 * n + 1\n  k += 1\nanswer = k"


@query("rv18_branches_over_rows", "WITH RECURSIVE c AS (SELECT o_orderkey, o_orderkey % 50 + 1 AS n, 0 AS k FROM orders UNION ALL SELECT o_orderkey, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, k + 1 FROM c WHERE n <> 1) SELECT o_orderkey, CAST(max(k) AS VARCHAR) AS answer FROM c GROUP BY o_orderkey")
def branches_over_rows(spark, sf):
    """One run for each order key, dealt to all tasks; a missing key takes no step."""
    keys = table(spark, sf, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey").distinct()
    runs = tables.run_over(keys.where("o_orderkey is not null").withColumn("x", F.col("o_orderkey")), _COLLATZ, ["x"], "answer", most=20_000).select("o_orderkey", "answer")
    return runs.union(keys.where("o_orderkey is null").withColumn("answer", F.lit("0")))


def _folder(spark) -> str:
    return f"{fixpoint.shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, sf) -> DataFrame:
    """Events as a stream of files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parque[t]")


_TOTAL = "t = 0\nwhile True:\n  t = t + suspend(t)"


@query("rm05_suspend_resume", "SELECT user_id AS key, CAST(sum(CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INT)) AS VARCHAR) AS total, count(*) AS resumed FROM events GROUP BY user_id")
def suspend_resume(spark, sf):
    """A suspended program a user, resumed with each of the user's events as they stream in."""
    values = _event_stream(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.regexp_extract("props", "(-?[0-9]+)", 1).cast("bigint").alias("value"))
    rows = sessions.drain(sessions.resume_programs(values, _TOTAL), _folder(spark), "update")
    last = Window.partitionBy("key").orderBy(F.desc("resumed"))
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").select("key", F.col("waiting").alias("total"), "resumed")


@query("rm06_windowed_stream", "SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def windowed_stream(spark, sf):
    """Counts a day and kind in a stream of events."""
    rows = sessions.drain(sessions.windowed_counts(_event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day"), _folder(spark), "update")
    return rows.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "kind").agg(F.max("n").alias("n"))
