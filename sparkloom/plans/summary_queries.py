"""Registered queries of interprocedural summaries over lowered sources, with hand-derived answers as their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import cfg, inference, interproc, registry, summaries
from sparkloom.plans import fixpoint
from sparkloom.plans.schema import INSTR, values_sql
from sparkloom.vm import tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = fixpoint.scoped(f)
        ORACLES[name] = sql
        return f

    return add


#: Program 1, by the Python frontend: each way from a parameter to a result or a field, and calls of them.
SOURCE = """
def pick(a, b):
  return a
def add(a, b):
  return a + b
def via(a):
  x = a
  y = x + 1
  return y
def setf(o, v):
  o.f = v
def getf(o):
  t = o.f
  return t
def main(p, q):
  r = add(p, q)
  s = pick(r, q)
  setf(p, s)
  return s
"""
#: Program 2, instructions of a language with pointers: a write and a read through a pointer, and calls of them with an address.
POINTERS = """
LABEL entry|BRANCH > end_setp_2
LABEL func_setp_1|%0 = SYMBOLIC param:ptr|DECL_VAR ptr %0|%1 = SYMBOLIC param:val|DECL_VAR val %1|%2 = LOAD_VAR ptr|%3 = LOAD_VAR val|STORE_INDIRECT %2 %3|%4 = CONST 0|RETURN %4
LABEL end_setp_2|BRANCH > end_getp_4
LABEL func_getp_3|%5 = SYMBOLIC param:ptr|DECL_VAR ptr %5|%6 = LOAD_VAR ptr|%7 = LOAD_INDIRECT %6|RETURN %7
LABEL end_getp_4|BRANCH > end_main_6
LABEL func_main_5|%8 = CONST 1|DECL_VAR x %8|%9 = ADDRESS_OF x|%10 = SYMBOLIC param:n|DECL_VAR n %10|%11 = LOAD_VAR n|%12 = CALL_FUNCTION setp %9 %11|%13 = ADDRESS_OF x|%14 = CALL_FUNCTION getp %13|DECL_VAR y %14|%15 = LOAD_VAR y|RETURN %15
LABEL end_main_6
"""


def instructions(text: str, program_id: int) -> list[tuple]:
    """Rows of the instruction table from its text form."""
    rows = []
    for pc, line in enumerate(x for y in text.strip().splitlines() for x in y.split("|")):
        line, _, to = line.partition(" > ")
        reg, _, rest = line.rpartition(" = ")
        op, *ops = rest.split()
        rows.append((program_id, pc, op, reg, [] if op == "LABEL" else ops, ops[0] if op == "LABEL" else "", to.split()))
    return rows


def _programs(spark):
    """Placed instructions of both programs."""

    def make():
        tables.register(spark)
        spark.createDataFrame([(1, "python", SOURCE)], "program_id bigint, language string, source string").createOrReplaceTempView("sparkloom_summaries")
        lowered = spark.sql("SELECT program_id, r.* FROM sparkloom_summaries s, LATERAL lower_source(s.source, s.language) r")
        return cfg.placed(lowered.union(spark.createDataFrame(instructions(POINTERS, 2), INSTR)))

    return fixpoint.once("summary_programs", make)


def _flows(spark):
    return fixpoint.once("summary_flows", lambda: summaries.summary(_programs(spark)))


def _name(c: str):
    return F.regexp_extract(c, registry.FUNC, 1)


PARAMS = [(1, "pick", 0, "a"), (1, "pick", 1, "b"), (1, "add", 0, "a"), (1, "add", 1, "b"), (1, "via", 0, "a"), (1, "setf", 0, "o"), (1, "setf", 1, "v"), (1, "getf", 0, "o"), (1, "main", 0, "p"), (1, "main", 1, "q"), (2, "setp", 0, "ptr"), (2, "setp", 1, "val"), (2, "getp", 0, "ptr"), (2, "main", 0, "n")]
RETURNS = [(1, "pick", "a", "return pick"), (1, "add", "a", "return add"), (1, "add", "b", "return add"), (1, "via", "a", "return via"), (1, "getf", "o", "return getf"), (1, "getf", "o.f", "return getf"), (1, "main", "p", "return main"), (1, "main", "q", "return main"), (2, "getp", "*ptr", "return getp")]
FIELDS = [(1, "setf", "v", "o.f")]
POINTED = [(2, "setp", "ptr", "*ptr"), (2, "setp", "val", "*ptr")]
CALLED = [(1, "main", "add", "p", "r"), (1, "main", "add", "q", "r"), (1, "main", "pick", "r", "s"), (1, "main", "setf", "s", "p.f"), (2, "main", "setp", "x", "x"), (2, "main", "setp", "n", "x"), (2, "main", "getp", "x", "y")]
CONTEXTS = [(1, "pick", "main", 1), (1, "add", "main", 2), (1, "via", None, 1), (1, "setf", "main", 1), (1, "getf", None, 2), (1, "main", None, 2), (2, "setp", "main", 2), (2, "getp", "main", 1), (2, "main", None, 0)]
REPORT = [(1, "pick", 1, 0, 1, 0, 0), (1, "add", 1, 0, 2, 0, 0), (1, "via", 0, 0, 1, 0, 0), (1, "setf", 1, 0, 0, 1, 0), (1, "getf", 0, 0, 1, 0, 1), (1, "main", 0, 3, 2, 0, 0), (2, "setp", 1, 0, 0, 0, 2), (2, "getp", 1, 0, 0, 0, 1), (2, "main", 0, 2, 0, 0, 0)]
ACCESSES = [(1, "RETURN", 5 + 6), (1, "STORE_FIELD", 1), (1, "LOAD_FIELD", 1), (2, "RETURN", 3), (2, "STORE_INDIRECT", 1), (2, "LOAD_INDIRECT", 1)]
_EDGES = [(p, s, d) for p, _, s, d in RETURNS + FIELDS + POINTED] + [(p, s, d) for p, _, _, s, d in CALLED]


def _ends(flows):
    """Flows by the functions' names."""
    text = lambda end: F.when(F.col(f"{end}_kind") == "return", F.concat(F.lit("return "), _name(end))).otherwise(summaries.endpoint(end))
    return flows.select("program_id", _name("func").alias("func"), text("src").alias("src"), text("dst").alias("dst"))


@query("ri06_stored_parameters", "SELECT * FROM " + values_sql(PARAMS, "program_id, func, pos, param"))
def stored_parameters(spark, sf):
    p = summaries.parameters(summaries.bodies(_programs(spark)))
    return p.select("program_id", _name("func").alias("func"), "pos", "param")


@query("ri07_returns_and_accesses", "SELECT * FROM " + values_sql(ACCESSES, "program_id, opcode, n"))
def returns_and_accesses(spark, sf):
    return summaries.accesses(summaries.bodies(_programs(spark))).groupBy("program_id", "opcode").agg(F.count(F.lit(1)).alias("n"))


@query("ri08_loaded_variables", "SELECT * FROM " + values_sql([(2, "%2", "ptr"), (2, "%3", "val"), (2, "%6", "ptr"), (2, "%11", "n"), (2, "%15", "y")], "program_id, reg, var"))
def loaded_variables(spark, sf):
    return summaries.loaded(summaries.bodies(_programs(spark))).where("program_id = 2").select("program_id", "reg", "var")


@query("ri10_return_flows", "SELECT * FROM " + values_sql(RETURNS, "program_id, func, src, dst"))
def return_flows(spark, sf):
    return _ends(_flows(spark).where("dst_kind = 'return'"))


@query("ri11_field_flows", "SELECT * FROM " + values_sql(FIELDS, "program_id, func, src, dst"))
def field_flows(spark, sf):
    return _ends(_flows(spark).where("dst_kind = 'field'"))


@query("ri12_pointer_flows", "SELECT * FROM " + values_sql(POINTED, "program_id, func, src, dst"))
def pointer_flows(spark, sf):
    return _ends(_flows(spark).where("dst_kind = 'dereference'"))


@query("ri13_function_summaries", "SELECT * FROM " + values_sql(RETURNS + FIELDS + POINTED, "program_id, func, src, dst"))
def function_summaries(spark, sf):
    return _ends(_flows(spark))


@query("ri14_call_contexts", "SELECT * FROM " + values_sql(CONTEXTS, "program_id, func, caller, flows"))
def call_contexts(spark, sf):
    c = summaries.contexts(_programs(spark), _flows(spark))
    return c.select("program_id", _name("func").alias("func"), _name("caller").alias("caller"), "flows")


@query("ri15_substituted_flows", "SELECT * FROM " + values_sql(CALLED, "program_id, caller, func, src, dst"))
def substituted_flows(spark, sf):
    s = summaries.substituted(_programs(spark), _flows(spark))
    return s.select("program_id", _name("caller").alias("caller"), _name("func").alias("func"), "src", "dst")


@query("ri17_whole_program", f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM {values_sql(_EDGES, 'program_id, src, dst')}), c AS (SELECT * FROM e UNION SELECT c.program_id, c.src, e.dst FROM c JOIN e ON e.program_id = c.program_id AND e.src = c.dst) SELECT * FROM c")
def whole_program(spark, sf):
    """The orchestrated analysis: calls, summaries, contexts, the graph of all flows, closed."""
    closed = summaries.analyze(_programs(spark))["closed"]
    bare = lambda c: F.regexp_replace(c, r"^return (?:.*\.)?func_(.+)_\d+$", "return $1")
    return closed.select("program_id", bare("src").alias("src"), bare("dst").alias("dst"))


@query("ri22_merged_flows", "SELECT program_id, func, count(DISTINCT src || dst) AS flows FROM " + values_sql(RETURNS + FIELDS + POINTED, "program_id, func, src, dst") + " GROUP BY program_id, func")
def merged_flows(spark, sf):
    """Flows of a function over all its contexts."""
    per_context = summaries.contexts(_programs(spark), _flows(spark)).where("flows > 0").select("program_id", "func").join(_flows(spark), ["program_id", "func"])
    return _ends(per_context).distinct().groupBy("program_id", "func").agg(F.count(F.lit(1)).alias("flows"))


@query("ri24_typed_report", "SELECT * FROM " + values_sql(REPORT, "program_id, func, callers, callees, param_to_return, param_to_field, other"))
def typed_report(spark, sf):
    r = summaries.report(_programs(spark), _flows(spark))
    return r.select("program_id", _name("func").alias("func"), "callers", "callees", "param_to_return", "param_to_field", "other")


_KINDS = [(2, "entry", "entry", None), (2, "func_setp_1", "function", "setp"), (2, "end_setp_2", "end", "setp"), (2, "func_getp_3", "function", "getp"), (2, "end_getp_4", "end", "getp"), (2, "func_main_5", "function", "main"), (2, "end_main_6", "end", "main"), (3, "m.entry", "entry", None), (3, "m.func_a_b_1", "function", "a_b"), (3, "m.n.class_C_2", "class", "C"), (3, "end_class_C_3", "end_class", "C"), (3, "if_end_4", "block", None)]


@query("rp06_label_kinds", "SELECT program_id, label, kind, name, CASE label WHEN 'm.entry' THEN 'm' WHEN 'm.func_a_b_1' THEN 'm' WHEN 'm.n.class_C_2' THEN 'm.n' ELSE '' END AS namespace FROM " + values_sql(_KINDS, "program_id, label, kind, name"))
def label_kinds(spark, sf):
    more = "LABEL m.entry|LABEL m.func_a_b_1|LABEL m.n.class_C_2|LABEL end_class_C_3|LABEL if_end_4"
    return registry.label_kinds(spark.createDataFrame(instructions(POINTERS, 2) + instructions(more, 3), INSTR))


#: Program 4: a loop and a branch inside a function, a function after it, code that nothing reaches.
BRANCHES = """
LABEL entry|BRANCH > end_f_2
LABEL func_f_1|%0 = SYMBOLIC param:n|DECL_VAR n %0|LABEL top|%1 = LOAD_VAR n|BRANCH_IF %1 > body done|LABEL body|BRANCH > top|LABEL done|%2 = CONST 1|RETURN %2|LABEL dead|%3 = CONST 2|RETURN %3
LABEL end_f_2|BRANCH > end_g_4
LABEL func_g_3|%4 = CONST 3|RETURN %4
LABEL end_g_4
"""


@query("rg09_function_graphs", "SELECT * FROM " + values_sql([("f", "func_f_1", "top"), ("f", "top", "body"), ("f", "top", "done"), ("f", "body", "top")], "func, src, dst"))
def function_graphs(spark, sf):
    """Edges of each function's own graph: what its entry reaches inside its body."""
    p = cfg.placed(spark.createDataFrame(instructions(BRANCHES, 4), INSTR))
    return summaries.function_cfg(p)[1].select(_name("func").alias("func"), "src", "dst")


_WAYS = [(1, "a", "b"), (1, "b", "d"), (1, "a", "c"), (1, "c", "d"), (1, "d", "e"), (1, "e", "b"), (2, "x", "y"), (3, "s", "s")]


@query("ri21_taint_witnesses", "SELECT * FROM (VALUES (1, 'a', 'd', 'a > b > d'), (1, 'a', 'e', 'a > b > d > e'), (1, 'a', 'a', 'a'), (1, 'e', 'a', ''), (2, 'x', 'y', 'x > y'), (2, 'y', 'x', '')) v(program_id, source, sink, path)")
def taint_witnesses(spark, sf):
    """A shortest path from each source to its sink."""
    edges = spark.createDataFrame(_WAYS, "program_id bigint, src string, dst string")
    pairs = spark.createDataFrame([(1, "a", "d"), (1, "a", "e"), (1, "a", "a"), (1, "e", "a"), (2, "x", "y"), (2, "y", "x")], "program_id bigint, source string, sink string")
    t = interproc.taint_path(edges, pairs)
    return t.select("program_id", "source", "sink", F.array_join("path", " > ").alias("path"))


@query("rg16_cycle_witnesses", "SELECT * FROM (VALUES (1, 'b > d > e > b'), (3, 's > s')) v(program_id, cycle)")
def cycle_witnesses(spark, sf):
    c = fixpoint.cycle_by_key(spark.createDataFrame(_WAYS, "program_id bigint, src string, dst string"), "program_id")
    return c.select("program_id", F.array_join("cycle", " > ").alias("cycle"))


_TYPED = "def add(a, b):\n  return a + b\ndef size(s):\n  return len(s)\ndef either(a):\n  if a:\n    return a\n  return 'x'\ndef nothing():\n  pass"


@query("rt06_signatures", "SELECT * FROM (VALUES ('add(a: Int, b: Float) -> Float'), ('size(s: String) -> Int'), ('either(a: Int) -> Any'), ('nothing() -> Null')) v(signature)")
def signatures(spark, sf):
    """Functions with the types of their parameters, given, and of their results, inferred."""
    tables.register(spark)
    spark.createDataFrame([(5, "python", _TYPED)], "program_id bigint, language string, source string").createOrReplaceTempView("sparkloom_typed")
    instr = spark.sql("SELECT program_id, r.* FROM sparkloom_typed s, LATERAL lower_source(s.source, s.language) r")
    types = fixpoint.checkpointed(inference.infer(instr, {"a": "Int", "b": "Float", "s": "String"}))
    return inference.signatures(cfg.placed(instr), types).select("signature")
