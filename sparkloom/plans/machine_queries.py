"""Registered queries of the machine: a program for each built-in, opcode and operator, with its answer worked out by hand."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sparkloom.functions import operators as O
from sparkloom.plans.schema import values_sql
from sparkloom.vm import tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


_BOX = "class In:\n  def hi(self, n): return n + 1\nclass Box:\n  def __init__(self, x): self.__boxed__ = x\n  def __method_missing__(self, name, n): return name\n"
_POINT = "class P:\n  def __init__(self, x, y):\n    self.x = x\n    self.y = y\n"
#: (case, Python program, value of answer)
BUILTINS = [
    ("len of text", "answer = len('four')", 4), ("len of array", "answer = len([1, 2, 3])", 3), ("strlen", "answer = strlen('four')", 4),
    ("range to", "answer = range(3)", [0, 1, 2]), ("range from to", "answer = range(2, 5)", [2, 3, 4]), ("range by step", "answer = range(7, 1, -3)", [7, 4]),
    ("int truncates", "answer = int(-2.7)", -2), ("int of text", "answer = int('42')", 42), ("float", "answer = float('1.5')", 1.5), ("str", "answer = str(12) + '!'", "12!"), ("bool", "answer = [bool(0), bool('x')]", [False, True]),
    ("abs", "answer = abs(-3)", 3), ("max of arguments", "answer = max(3, 9, 4)", 9), ("max of array", "answer = max([3, 9, 4])", 9), ("min", "answer = min(3, 9, 4)", 3),
    ("keys", "answer = keys({'a': 1, 'b': 2})", ["a", "b"]), ("keys of array", "answer = keys([7, 8])", ["0", "1"]),
    ("arrayOf", "answer = arrayOf(1, 2)", [1, 2]), ("intArrayOf", "answer = intArrayOf(3)", [3]), ("listOf", "answer = listOf()", []), ("mutableListOf", "x = mutableListOf(1)\nx.append(2)\nanswer = x", [1, 2]), ("Array", "answer = Array(5, 6)", [5, 6]),
    ("slice", "answer = slice([1, 2, 3, 4, 5], 1, 4)", [2, 3, 4]), ("slice from", "answer = slice([1, 2, 3], 1)", [2, 3]), ("slice by step", "answer = slice([1, 2, 3, 4, 5], 'None', 'None', 2)", [1, 3, 5]), ("slice from the end", "answer = slice('abcdef', -2)", "ef"), ("slice backwards", "answer = slice([1, 2, 3], None, None, -1)", [3, 2, 1]),
    ("subList", "answer = [1, 2, 3, 4].subList(1, 3)", [2, 3]), ("substring", "answer = 'abcdef'.substring(2, 4)", "cd"),
    ("clone is apart", _POINT + "a = P(1, 2)\nb = clone(a)\nb.x = 9\nanswer = [a.x, b.x, b.y]", [1, 9, 2]),
    ("isinstance by name", _POINT + "answer = isinstance(P(1, 2), P)", True), ("isinstance is exact", "class A:\n  pass\nclass B(A):\n  pass\nanswer = isinstance(B(), A)", False), ("isinstance of primitives", "answer = [isinstance(3, 'int'), isinstance('x', 'String'), isinstance(3, 'Float'), isinstance(3, 'Cat')]", [True, True, False, False]),
    ("object_rest", "answer = object_rest({'a': 1, 'b': 2, 'c': 3}, 'a', 'c')", {"b": 2}),
    ("str_upper", "answer = str_upper('aé')", "AÉ"), ("str_lower", "answer = str_lower('AÉ')", "aé"), ("str_strip", "answer = str_strip(' \t x \\n')", "x"),
    ("list_append", "x = [1]\nlist_append(x, 2)\nanswer = [x, len(x)]", [[1, 2], 2]),
    ("dict_contains_key", "d = {'a': 1}\nanswer = [dict_contains_key(d, 'a'), dict_contains_key(d, 1)]", [True, False]),
    ("contains looks at values", "answer = [__py_contains__([4, 5], 5), __py_contains__([4, 5], 1), __py_contains__({'k': 7}, 7), __py_contains__('abc', 'b')]", [True, False, True, True]),
    ("to_string", "answer = (12).to_string() + (3).toString()", "123"), ("length, size", "answer = ['abc'.length(), [1, 2].size(), 'x'.Length()]", [3, 2, 1]),
    ("method_missing delegates", _BOX + "answer = Box(Box(In())).hi(41)", 42), ("method_missing answers", _BOX + "answer = Box(In()).other(1)", "other"),
    ("shadowing", "x = 1\ndef f(x): return x * 10\nanswer = f(2) + x", 21), ("closures keep their variable", "def make():\n  n = 0\n  def up():\n    n = n + 1\n    return n\n  return up\nf = make()\nf()\nanswer = f()", 2),
]


@query("rb01_builtins", "SELECT * FROM " + values_sql([(n, json.dumps(a)) for n, _, a in BUILTINS], "name, answer"))
def builtins(spark, sf):
    tables.register(spark)
    spark.createDataFrame([(n, s) for n, s, _ in BUILTINS], "name string, source string").createOrReplaceTempView("sparkloom_builtins")
    return spark.sql("SELECT name, r.answer FROM sparkloom_builtins p, LATERAL run_source(p.source, 'python', 'answer', 5000) r")


def _code(text: str) -> str:
    """Instructions as JSON from lines ``[register =] OPCODE json-operands [> targets]``; ``NAME:`` is a label."""
    rows = []
    for line in text.split(";"):
        line = line.strip()
        if line.endswith(":"):
            rows.append(["LABEL", "", [], line[:-1], []])
            continue
        line, _, to = line.partition(" > ")
        reg, _, rest = line.rpartition(" = ") if line.startswith("%") else ("", "", line)
        op, _, ops = rest.partition(" ")
        rows.append([op, reg, json.loads(f"[{ops}]"), "", to.split()])
    return json.dumps(rows)


_DOUBLE = "BRANCH > end_f; func_f_1:; %1 = SYMBOLIC \"param:n\"; %2 = BINOP \"+\", \"%1\", \"%1\"; RETURN \"%2\"; end_f:; %0 = CONST {\"func\": \"func_f_1\"}; DECL_VAR \"f\", \"%0\"; "
_CLASS = "BRANCH > end_i; func___init___1:; %1 = SYMBOLIC \"param:self\"; %2 = SYMBOLIC \"param:v\"; STORE_FIELD \"%1\", \"v\", \"%2\"; %3 = CONST null; RETURN \"%3\"; end_i:; %0 = CONST {\"class\": \"C\", \"methods\": [[\"__init__\", \"func___init___1\"]]}; DECL_VAR \"C\", \"%0\"; "
_THIS = "BRANCH > end_m; func_m_1:; %1 = SYMBOLIC \"param:this\"; DECL_VAR \"this\", \"%1\"; %2 = LOAD_VAR \"count\"; %3 = CONST 1; %4 = BINOP \"+\", \"%2\", \"%3\"; STORE_VAR \"count\", \"%4\"; RETURN \"%4\"; end_m:; %0 = CONST {\"class\": \"C\", \"methods\": [[\"m\", \"func_m_1\"]]}; %5 = NEW_OBJECT \"C\"; DECL_VAR \"C\", \"%0\"; %6 = CONST 4; STORE_FIELD \"%5\", \"count\", \"%6\"; %7 = CALL_METHOD \"%5\", \"m\"; %8 = LOAD_FIELD \"%5\", \"count\"; DECL_VAR \"answer\", \"%8\""
#: (case, instructions, bare names of fields, value of answer)
OPCODES = [
    ("NEW_OBJECT", '%0 = NEW_OBJECT "Cat"; %1 = CONST 3; STORE_FIELD "%0", "age", "%1"; DECL_VAR "answer", "%0"', False, {"age": 3}),
    ("CALL_UNKNOWN", _DOUBLE + '%3 = LOAD_VAR "f"; %4 = CONST 21; %5 = CALL_UNKNOWN "%3", "%4"; DECL_VAR "answer", "%5"', False, 42),
    ("CALL_CTOR", _CLASS + '%4 = CONST 8; %5 = CALL_CTOR "C", "%4"; DECL_VAR "answer", "%5"', False, {"v": 8}),
    ("CALL_WITH_MEMORY", _DOUBLE + '%4 = CONST 4; %5 = CALL_WITH_MEMORY "f", "%4"; DECL_VAR "answer", "%5"', False, 8),
    ("HALT", '%0 = CONST 1; DECL_VAR "answer", "%0"; HALT; %1 = CONST 2; STORE_VAR "answer", "%1"', False, 1),
    ("ALLOC_REGION", '%0 = CONST 3; %1 = ALLOC_REGION "%0"; %2 = CONST 0; %3 = LOAD_REGION "%1", "%2", "%0"; DECL_VAR "answer", "%3"', False, [0, 0, 0]),
    ("WRITE_REGION", '%0 = CONST 4; %1 = ALLOC_REGION "%0"; %2 = CONST 1; %3 = CONST 2; %4 = CONST [7, 9, 11]; WRITE_REGION "%1", "%2", "%3", "%4"; %5 = CONST 0; %6 = LOAD_REGION "%1", "%5", "%0"; DECL_VAR "answer", "%6"', False, [0, 7, 9, 0]),
    ("ADDRESS_OF, LOAD_INDIRECT", '%0 = CONST 5; DECL_VAR "x", "%0"; %1 = ADDRESS_OF "x"; %2 = LOAD_INDIRECT "%1"; DECL_VAR "answer", "%2"', False, 5),
    ("STORE_INDIRECT", '%0 = CONST 5; DECL_VAR "x", "%0"; %1 = ADDRESS_OF "x"; %2 = CONST 6; STORE_INDIRECT "%1", "%2"; %3 = LOAD_VAR "x"; DECL_VAR "answer", "%3"', False, 6),
    ("LOAD_FIELD_INDIRECT", '%0 = NEW_OBJECT "Cat"; %1 = CONST 3; STORE_FIELD "%0", "age", "%1"; %2 = CONST "age"; %3 = LOAD_FIELD_INDIRECT "%0", "%2"; DECL_VAR "answer", "%3"', False, 3),
    ("IMPORT_MODULE", '%0 = IMPORT_MODULE "os"; DECL_VAR "m", "%0"; %1 = CONST 1; DECL_VAR "answer", "%1"', False, 1),
    ("SET and RESUME_CONTINUATION", 'SET_CONTINUATION "k", "back"; BRANCH > part; back:; %0 = CONST 2; DECL_VAR "answer", "%0"; HALT; part:; RESUME_CONTINUATION "k"; %1 = CONST 3; DECL_VAR "answer", "%1"', False, 2),
    ("TRY and THROW", 'TRY_PUSH > catch; %0 = CONST 9; THROW "%0"; HALT; catch:; %1 = SYMBOLIC "caught_exception:e"; DECL_VAR "answer", "%1"', False, 9),
    ("bare field of this", _THIS, True, 5), ("no bare fields", _THIS, False, 4),
    ("unsigned shift is unknown", '%0 = CONST 8; %1 = BINOP ">>>", "%0", "%0"; DECL_VAR "answer", "%1"', False, "<sym_0>"), ("channel receive is unknown", '%0 = CONST 8; %1 = UNOP "<-", "%0"; DECL_VAR "answer", "%1"', False, "<sym_0>"),
    ("unresolved call is unknown", '%0 = CALL_FUNCTION "nowhere"; DECL_VAR "answer", "%0"', False, "<sym_0>"),
]


@query("rv01_opcodes", "SELECT * FROM " + values_sql([(n, json.dumps(a)) for n, _, _, a in OPCODES], "name, answer"))
def opcodes(spark, sf):
    tables.register(spark)
    spark.createDataFrame([(n, _code(c), t) for n, c, t, _ in OPCODES], "name string, code string, this boolean").createOrReplaceTempView("sparkloom_opcode_programs")
    return spark.sql("SELECT name, r.answer FROM sparkloom_opcode_programs p, LATERAL run_code(p.code, 'answer', p.this, 500) r")


_UNSURE = '%0 = SYMBOLIC "input"; BRANCH_IF "%0" > yes no; yes:; %1 = SYMBOLIC "more"; BRANCH_IF "%1" > end end; no:; HALT; end:; %2 = CONST "done"; %3 = CALL_FUNCTION "println", "%2"'


@query("rm17_path_conditions", "SELECT * FROM (VALUES ('sym_0 is true, sym_1 is true', 'done', 8, TRUE)) v(conditions, output, steps, finished)")
def path_conditions(spark, sf):
    """Branches on unknowns take their first target and note the condition."""
    tables.register(spark)
    spark.createDataFrame([(_code(_UNSURE),)], "code string").createOrReplaceTempView("sparkloom_unsure")
    r = spark.sql("SELECT r.* FROM sparkloom_unsure p, LATERAL run_code(p.code, 'answer', false, 500) r")
    return r.select(F.array_join("conditions", ", ").alias("conditions"), F.array_join("output", "|").alias("output"), "steps", "finished")


@query("ra03_execution_stats", "SELECT * FROM " + values_sql([("factorial", 4, 8 + 3 * 18 + 14, True), ("straight", 0, 5, True)], "name, calls, steps, finished"))
def execution_stats(spark, sf):
    """Steps taken and calls entered, from the trace of a run."""
    tables.register(spark)
    rows = [("factorial", "def f(n):\n  return 1 if n < 2 else n * f(n - 1)\nanswer = f(4)"), ("straight", "answer = 1 + 2")]
    spark.createDataFrame(rows, "name string, source string").createOrReplaceTempView("sparkloom_runs")
    t = spark.sql("SELECT name, t.step, t.opcode FROM sparkloom_runs p, LATERAL trace_source(p.source, 1000) t")
    per = t.groupBy("name").agg(F.count(F.when(F.col("opcode") == "CALL_FUNCTION", 1)).alias("calls"), F.max("step").alias("steps"))
    ends = spark.sql("SELECT name, r.finished FROM sparkloom_runs p, LATERAL run_source(p.source, 'python', 'answer', 1000) r")
    return per.join(ends, "name").select("name", "calls", "steps", "finished")


@query("ro07_more_operators", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN b <> 0 THEN a - b * CAST(floor(a / CAST(b AS DOUBLE)) AS BIGINT) END AS mod_, n IS DISTINCT FROM b AS tilde_eq, a > b AS gt_, a <= b AS le_, n IS NOT DISTINCT FROM n AS same_, NOT list_contains([b, 1, 2], a) AS not_in_, n IS NOT DISTINCT FROM b AS is_, n IS DISTINCT FROM a AS is_not_,
  xor(a, 255) AS tilde_, CAST(a AS VARCHAR) || CAST(b AS VARCHAR) AS dot_, coalesce(n, b) AS elvis_, CASE WHEN b <> 0 THEN b ELSE a END AS pipes_, CASE WHEN b <> 0 THEN a ELSE b END AS amps_, CAST(NULL AS VARCHAR) AS unsigned_, a = 0 AS bang_, a AS ref_, CAST(NULL AS VARCHAR) AS receive_
FROM (SELECT *, l_partkey - 100 AS a, l_suppkey % 7 - 3 AS b, CASE WHEN l_linenumber > 3 THEN l_partkey - 100 END AS n FROM lineitem)""")
def more_operators(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").withColumns({"a": F.col("l_partkey") - 100, "b": F.col("l_suppkey") % 7 - 3, "n": F.when(F.col("l_linenumber") > 3, F.col("l_partkey") - 100)})
    a, b, n, op, un = F.col("a"), F.col("b"), F.col("n"), O.BINARY, O.UNARY
    return t.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", op["mod"](a, b).alias("mod_"), op["~="](n, b).alias("tilde_eq"), op[">"](a, b).alias("gt_"), op["<="](a, b).alias("le_"), op["==="](n, n).alias("same_"), op["not in"](a, F.array(b, F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("not_in_"),
        op["is"](n, b).alias("is_"), op["is not"](n, a).alias("is_not_"), op["~"](a, F.lit(255)).alias("tilde_"), op["."](a, b).alias("dot_"), op["?:"](n, b).alias("elvis_"), op["||"](b, a).alias("pipes_"), op["&&"](b, a).alias("amps_"), op[">>>"](a, b).cast("string").alias("unsigned_"), un["!"](a).alias("bang_"), un["&"](a).alias("ref_"), un["<-"](a).cast("string").alias("receive_"),
    )


#: (case, Python program): two parameters and one with a default, one caught exception, two nodes without a lowering, one unknown from nowhere.
_HINTED = [("parameters", "def f(a, b, c=1):\n  return a"), ("exceptions", "try:\n  x = 1\nexcept E as e:\n  y = e"), ("unsupported", "async def g():\n  pass\nmatch x:\n  case 1: pass")]


@query("rp13_symbolic_audit", "SELECT * FROM (VALUES ('parameters', 'param', 3), ('exceptions', 'caught_exception', 1), ('unsupported', 'unsupported', 2)) v(name, category, n)")
def symbolic_audit(spark, sf):
    """SYMBOLIC rows of lowered programs by what their hint says."""
    tables.register(spark)
    spark.createDataFrame(_HINTED, "name string, source string").createOrReplaceTempView("sparkloom_hinted")
    i = spark.sql("SELECT name, r.operands[0] AS hint FROM sparkloom_hinted p, LATERAL lower_source(p.source, 'python') r WHERE r.opcode = 'SYMBOLIC'")
    kind = F.regexp_extract("hint", "^(param|caught_exception|unsupported)", 1)
    return i.groupBy("name", F.when(kind == "", "other").otherwise(kind).alias("category")).agg(F.count(F.lit(1)).alias("n"))
