"""Registered queries of linking, overload ambiguity, aliases, connections and figurative constants, with hand-derived answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import intrinsics as I
from sparkloom.functions import pictures
from sparkloom.operators import inference, link
from sparkloom.operators import types as Y
from sparkloom.plans import fixpoint
from sparkloom.plans.schema import values_sql
from sparkloom.sources import imports
from sparkloom.vm import tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = fixpoint.scoped(f)
        ORACLES[name] = sql
        return f

    return add


#: (project, program_id, place, prefix, source): a project of three modules and one with a library that is not there.
MODULES = [
    (1, 11, 0, "util", "def twice(x):\n  return x * 2\nBASE = 10"),
    (1, 12, 1, "mathx", "from util import twice\ndef quad(x):\n  return twice(twice(x))"),
    (1, 13, 2, "main", "from util import BASE\nfrom mathx import quad as q\nclass Box:\n  def __init__(self, v): self.v = v\n  def get(self): return self.v\ndef run():\n  return q(3) + Box(BASE).get()\nanswer = q(2) + BASE"),
    (2, 21, 0, "alone", "import os\nanswer = 7"),
]


def _code(spark):
    def make():
        tables.register(spark)
        spark.createDataFrame(MODULES, "project bigint, program_id bigint, place int, prefix string, source string").createOrReplaceTempView("sparkloom_modules")
        return spark.sql("SELECT program_id, r.* FROM sparkloom_modules s, LATERAL lower_code(s.source, 'python') r")

    modules = spark.createDataFrame([m[:4] for m in MODULES], "project bigint, program_id bigint, place int, prefix string")
    return fixpoint.once("module_code", make), modules


@query("rl02_namespaced_symbols", "SELECT * FROM " + values_sql([(1, "twice", "util.func_twice_1"), (1, "BASE", None), (1, "quad", "mathx.func_quad_1"), (1, "run", "main.func_run_7"), (1, "answer", None), (1, "q", None), (1, "Box", None), (2, "os", None), (2, "answer", None)], "project, name, label"))
def namespaced_symbols(spark, sf):
    """The symbol table of each project: bare names, functions with their namespaced labels; imported names are no module's own."""
    code, modules = _code(spark)
    own = link.exports(code, modules)
    again = link.resolved_imports(code, modules).where("resolved").join(modules.select("program_id", F.col("prefix").alias("by")), "program_id").select("project", F.col("by").alias("module"), "name")
    return own.join(again, ["project", "module", "name"], "left_anti").select("project", "name", "label")


@query("rl03_module_bases", "SELECT * FROM " + values_sql([(1, "util", 0, 7), (1, "mathx", 7, 7), (1, "main", 14, 24), (2, "alone", 0, 2)], "project, prefix, base, registers"))
def module_bases(spark, sf):
    return link.module_bases(*_code(spark)).select("project", "prefix", "base", "registers")


@query("rl06_resolved_imports", "SELECT * FROM " + values_sql([(1, 12, "util", "twice", 1), (1, 13, "util", "BASE", 1), (1, 13, "mathx", "quad", 1), (2, 21, "os", None, 0)], "project, program_id, module, name, resolved"))
def resolved_imports(spark, sf):
    return link.resolved_imports(*_code(spark)).select("project", "program_id", "module", "name", F.col("resolved").cast("int").alias("resolved"))


@query("rl04_expanded_imports", "SELECT * FROM " + values_sql([(1, "LOAD_VAR", 3), (2, "IMPORT_MODULE", 1)], "project, opcode, n"))
def expanded_imports(spark, sf):
    """What the imports of the modules have become."""
    code, modules = _code(spark)
    linked = link.link_modules(code, modules)
    was = code.where("opcode = 'IMPORT_MODULE'").join(link.module_bases(code, modules), "program_id")
    reg = F.concat(F.lit("%"), (F.substring("result_reg", 2, 20).cast("bigint") + F.col("base")).cast("string"))
    now = was.select(F.col("project").alias("program_id"), reg.alias("result_reg")).join(linked, ["program_id", "result_reg"])
    return now.groupBy(F.col("program_id").alias("project"), "opcode").agg(F.count(F.lit(1)).alias("n"))


@query("rl07_linked_modules", "SELECT * FROM (VALUES (1, 1, 0, 0, TRUE), (2, 1, 0, 0, TRUE)) v(project, entries, shared_registers, lost_targets, dense)")
def linked_modules(spark, sf):
    """One entry, no register written by two instructions, no target without its label, no gap between instructions."""
    linked = fixpoint.checkpointed(link.link_modules(*_code(spark)))
    shape = linked.groupBy("program_id").agg(F.count(F.when(F.col("label") == "entry", 1)).alias("entries"), (F.count(F.when(F.col("result_reg") != "", 1)) - F.countDistinct(F.when(F.col("result_reg") != "", F.col("result_reg")))).alias("shared_registers"), (F.max("pc") + 1 == F.countDistinct("pc")).alias("dense"))
    targets = linked.select("program_id", F.explode("branch_targets").alias("label")).distinct()
    lost = targets.join(linked.where("opcode = 'LABEL'").select("program_id", "label"), ["program_id", "label"], "left_anti").groupBy("program_id").agg(F.count(F.lit(1)).alias("lost_targets"))
    return shape.join(lost, "program_id", "left").select(F.col("program_id").alias("project"), "entries", "shared_registers", F.coalesce("lost_targets", F.lit(0)).alias("lost_targets"), "dense")


@query("rm07_linked_run", "SELECT * FROM (VALUES (1, '18', '22', TRUE), (2, '7', NULL, TRUE)) v(project, answer, result, finished)")
def linked_run(spark, sf):
    """Linked programs run in two phases: all modules' top levels, then the entry function."""
    r = tables.run_table(link.link_modules(*_code(spark)), "answer", entry="run")
    return r.select(F.col("program_id").alias("project"), "answer", "result", "finished")


@query("rt05_type_aliases", "SELECT * FROM " + values_sql([("Num", "Int"), ("Id", "Int"), ("Key", "Int"), ("A", "A"), ("B", "B"), ("C", "C"), ("Self", "Self")], "name, target"))
def type_aliases(spark, sf):
    rows = [("Num", "Int"), ("Id", "Num"), ("Key", "Id"), ("A", "B"), ("B", "A"), ("C", "A"), ("Self", "Self")]
    return inference.resolve_aliases(spark.createDataFrame(rows, "name string, target string"))


@query("ra15_ambiguous_overloads", "SELECT p_partkey, 0 AS chosen, p_partkey % 3 > 0 AS ambiguous FROM part")
def ambiguous_overloads(spark, sf):
    """Parts with one candidate or more: the first is taken, and marked where others were ranked."""
    c = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))).alias("ord")).select("p_partkey", "ord", F.lit(1).alias("n_params"), F.lit(1).alias("n_args"), F.lit(2).alias("score"))
    return Y.choose(Y.rank_overloads(c, ["p_partkey"])).select("p_partkey", F.col("ord").alias("chosen"), "ambiguous")


_COBOL = [
    ("src/main.cbl", "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. MAINPGM.\n      * CALL 'NOT-ME'.\n       COPY custrec.\n           CALL 'sub1' USING X.\n           CALL \"SUB1\".\n           CALL 'GONE'.\n"),
    ("src/sub1.cbl", "       PROGRAM-ID. SUB1.\n       COPY CUSTREC.\n       COPY ERRS.\n      / COPY NOTHING.\n"),
]
_FILES = [("src/main.cbl",), ("src/sub1.cbl",), ("cpy/CUSTREC.cpy",)]
_EDGES = [("MAINPGM", "COPY", "CUSTREC"), ("MAINPGM", "CALL", "SUB1"), ("MAINPGM", "CALL", "GONE"), ("SUB1", "COPY", "CUSTREC"), ("SUB1", "COPY", "ERRS")]
_NODES = [("PROGRAM", "MAINPGM", "src/main.cbl"), ("PROGRAM", "SUB1", "src/sub1.cbl"), ("PROGRAM", "GONE", None), ("COPYBOOK", "CUSTREC", None), ("COPYBOOK", "ERRS", None)]


def _graph(spark):
    return imports.connections(spark.createDataFrame(_COBOL, "path string, source string"), spark.createDataFrame(_FILES, "path string"))


@query("rg22_program_edges", "SELECT * FROM " + values_sql(_EDGES, "src, kind, dst"))
def program_edges(spark, sf):
    return _graph(spark)[1]


@query("rg22_program_nodes", "SELECT * FROM " + values_sql(_NODES, "kind, id, path"))
def program_nodes(spark, sf):
    return _graph(spark)[0]


@query("re11_figurative_constants", """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN repeat('30', 4) WHEN 1 THEN repeat('20', 4) WHEN 2 THEN repeat('FF', 4) WHEN 3 THEN repeat('00', 4) WHEN 4 THEN repeat('22', 4) ELSE '61626162' END AS bytes FROM nation""")
def figurative_constants(spark, sf):
    names = ("ZEROES", "SPACE", "HIGH-VALUES", "LOW-VALUE", "QUOTES", "ALL 'ab'")
    n = F.col("n_nationkey")
    value = F.coalesce(*[F.when(n % 6 == k, pictures.figurative(x, 4)) for k, x in enumerate(names)])
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.hex(value).alias("bytes"))


@query("rc47_test_numval_c", "SELECT s_suppkey, 0 AS money, 0 AS credit, 0 AS plain, 4 AS bad, 2 AS late FROM supplier")
def test_numval_c(spark, sf):
    k = F.col("s_suppkey").cast("string")
    t = lambda *x: I.test_numval_c(F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x]))
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", t("$", k, ",000.50").alias("money"), t(" ", k, " CR").alias("credit"), t("-", k).alias("plain"), t("$12x", k).alias("bad"), t("1$$", k).alias("late"))
