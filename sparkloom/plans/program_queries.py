"""Registered program-analysis queries over the derived programs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import cfg, dataflow, interproc
from sparkloom.plans import derived, fixpoint
from sparkloom.plans.schema import OPCODES, opcode_dim, values_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = fixpoint.scoped(f)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _placed(spark, sf) -> DataFrame:
    return fixpoint.once("placed", lambda: cfg.placed(derived.instr(spark, sf)))


def _graph(spark, sf):
    p = _placed(spark, sf)
    b = fixpoint.once("blocks", lambda: cfg.blocks(p))
    return p, b, fixpoint.once("edges", lambda: cfg.edges(b))


@query("ra01_opcode_histogram", derived.oracle("SELECT opcode, count(*) AS n FROM ins GROUP BY opcode"))
def opcode_histogram(spark, sf):
    return derived.instr(spark, sf).groupBy("opcode").agg(F.count(F.lit(1)).alias("n"))


@query("ri29_opcode_catalogue", f"SELECT opcode, category, fields FROM {values_sql(OPCODES, 'opcode, category, fields')} ORDER BY opcode")
def opcode_catalogue(spark, sf):
    return opcode_dim(spark).orderBy("opcode")


@query("ra02_program_stats", derived.oracle("""
SELECT i.program_id, count(*) AS instructions, count(DISTINCT i.block) AS blocks, count(DISTINCT CASE WHEN opcode = 'LABEL' THEN pc END) AS functions,
  count(DISTINCT CASE WHEN opcode = 'STORE_VAR' THEN var END) AS variables FROM ins i GROUP BY i.program_id"""))
def program_stats(spark, sf):
    p = _placed(spark, sf)
    var = F.when(F.col("opcode") == "STORE_VAR", F.get("operands", F.lit(0)))
    return p.groupBy("program_id").agg(
        F.count(F.lit(1)).alias("instructions"), F.countDistinct("block").alias("blocks"), F.count(F.when(F.col("opcode") == "LABEL", 1)).alias("functions"), F.countDistinct(var).alias("variables"))


@query("rp01_opcode_filter", derived.oracle("SELECT program_id, pc, result_reg, coalesce(p2, p1) AS left_reg, CASE WHEN p2 IS NOT NULL THEN p1 END AS right_reg FROM ins WHERE opcode = 'BINOP'"))
def opcode_filter(spark, sf):
    """All binary operations; those with fewer registers than two have nulls."""
    i = derived.instr(spark, sf).where("opcode = 'BINOP'")
    return i.select("program_id", "pc", "result_reg", F.get("operands", F.lit(1)).alias("left_reg"), F.get("operands", F.lit(2)).alias("right_reg"))


@query("rp02_writes", derived.oracle("SELECT program_id, block, idx, var FROM def"))
def writes(spark, sf):
    return cfg.writes(_placed(spark, sf))


@query("rp03_reads", derived.oracle("SELECT program_id, block, idx, var FROM use"))
def reads(spark, sf):
    return cfg.reads(_placed(spark, sf))


@query("rp04_operands", derived.oracle("""SELECT program_id, pc, CASE opcode WHEN 'LOAD_VAR' THEN var WHEN 'BINOP' THEN '+' || coalesce(' ' || p2, '') || coalesce(' ' || p1, '') WHEN 'STORE_VAR' THEN var || coalesce(' ' || p1, '') ELSE '' END AS operands FROM ins"""))
def operands(spark, sf):
    return derived.instr(spark, sf).select("program_id", "pc", F.array_join("operands", " ").alias("operands"))


#: The labels that an instruction of ``ins`` i branches to: j of the number it names, f of the next block.
_TARGETS = "JOIN cnt ON cnt.program_id = i.program_id LEFT JOIN blk j ON i.opcode IN ('BRANCH', 'BRANCH_IF') AND j.program_id = i.program_id AND j.block_ord = i.k % cnt.n LEFT JOIN blk f ON i.opcode = 'BRANCH_IF' AND f.program_id = i.program_id AND f.block_ord = i.ord + 1"
_MOVED = "'%r' || (CAST(substr({0}, 2) AS BIGINT) + 1000)"


@query("rp05_map_registers", derived.oracle(f"""SELECT i.program_id, i.pc, coalesce({_MOVED.format('i.result_reg')}, '') AS result_reg,
  CASE i.opcode WHEN 'LOAD_VAR' THEN i.var WHEN 'BINOP' THEN '+' || coalesce(' ' || {_MOVED.format('i.p2')}, '') || coalesce(' ' || {_MOVED.format('i.p1')}, '') WHEN 'STORE_VAR' THEN i.var || coalesce(' ' || {_MOVED.format('i.p1')}, '') ELSE '' END AS operands,
  CASE WHEN i.opcode = 'LABEL' THEN 'm.L' || i.event_id ELSE '' END AS label, coalesce('m.' || j.label, '') || coalesce(' m.' || f.label, '') AS targets FROM ins i {_TARGETS}"""))
def map_registers(spark, sf):
    """Registers renamed in results and operands, labels in definitions and targets, of all instructions."""
    moved = lambda x: F.when(x.rlike("^%[0-9]+$"), F.concat(F.lit("%r"), (F.substring(x, 2, 30).try_cast("bigint") + 1000).cast("string"))).otherwise(x)
    named = lambda x: F.when(x != "", F.concat(F.lit("m."), x)).otherwise(x)
    i = derived.instr(spark, sf)
    return i.select("program_id", "pc", F.coalesce(moved(F.col("result_reg")), F.lit("")).alias("result_reg"), F.array_join(F.transform("operands", moved), " ").alias("operands"), named(F.col("label")).alias("label"), F.array_join(F.transform("branch_targets", named), " ").alias("targets"))


@query("rp06_label_predicates", derived.oracle("SELECT program_id, label, block_ord = 0 AS is_entry, is_func AS is_function, n_instr = 0 AS is_empty FROM blk"))
def label_predicates(spark, sf):
    b = cfg.blocks(_placed(spark, sf))
    return b.select("program_id", "label", (F.col("block_ord") == 0).alias("is_entry"), F.col("label").rlike("^L[0-9]+$").alias("is_function"), (F.col("n_instr") == 0).alias("is_empty"))


@query("rp07_extract_name", derived.oracle("SELECT program_id, 'func_f' || first_event || '_0' AS label, 'f' || first_event AS name FROM fn"))
def extract_name(spark, sf):
    b = cfg.blocks(_placed(spark, sf)).where("label like 'L%'")
    label = F.concat(F.lit("func_f"), F.substring("label", 2, 30), F.lit("_0"))
    return b.select("program_id", label.alias("label"), F.regexp_extract(label, r"^(?:func|class)_(.+)_\d+$", 1).alias("name"))


@query("rp08_function_slice", derived.oracle("""
SELECT f.program_id, f.label, min(i.pc) AS first_pc, max(i.pc) AS last_pc, count(*) AS n FROM fn f JOIN own o ON o.program_id = f.program_id AND o.func = f.label
JOIN ins i ON i.program_id = o.program_id AND i.block = o.label GROUP BY f.program_id, f.label"""))
def function_slice(spark, sf):
    p = _placed(spark, sf)
    w = Window.partitionBy("program_id").orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    s = p.withColumn("func", F.last(F.when(F.col("opcode") == "LABEL", F.col("label")), ignorenulls=True).over(w)).where("func is not null")
    return s.groupBy("program_id", F.col("func").alias("label")).agg(F.min("pc").alias("first_pc"), F.max("pc").alias("last_pc"), F.count(F.lit(1)).alias("n"))


@query("rp11_ir_text", derived.oracle("""
SELECT i.program_id, i.pc, CASE i.opcode WHEN 'LABEL' THEN 'L' || i.event_id || ':' WHEN 'LOAD_VAR' THEN i.result_reg || ' = load_var ' || i.var
  WHEN 'BINOP' THEN i.result_reg || ' = binop +' || coalesce(' ' || i.p2, '') || coalesce(' ' || i.p1, '') WHEN 'STORE_VAR' THEN 'store_var ' || i.var || coalesce(' ' || i.p1, '')
  WHEN 'BRANCH' THEN 'branch ' || j.label WHEN 'BRANCH_IF' THEN 'branch_if ' || j.label || coalesce(', ' || f.label, '') ELSE 'return' END AS line FROM ins i """ + _TARGETS))
def ir_text(spark, sf):
    return cfg.text(_placed(spark, sf))


@query("rg01_leaders", derived.oracle("SELECT program_id, pc FROM ins WHERE leader"))
def leaders(spark, sf):
    return _placed(spark, sf).where("leader").select("program_id", "pc")


@query("rg02_blocks", derived.oracle("SELECT program_id, block_ord, label, first_pc, n_instr FROM blk"))
def blocks(spark, sf):
    return cfg.blocks(_placed(spark, sf)).select("program_id", "block_ord", "label", "first_pc", "n_instr")


@query("rg03_edges", derived.oracle("SELECT program_id, src, dst FROM edge"))
def edges(spark, sf):
    return _graph(spark, sf)[2].select("program_id", "src", "dst")


_REACH = "reach AS (SELECT program_id, label AS node FROM blk WHERE block_ord = 0 OR is_func UNION SELECT e.program_id, e.dst FROM reach r JOIN edge e ON e.program_id = r.program_id AND e.src = r.node)"


@query("rg05_reachable_blocks", derived.oracle("SELECT program_id, node FROM reach", _REACH))
def reachable(spark, sf):
    _, b, e = _graph(spark, sf)
    seeds = b.where("block_ord = 0 or label like 'L%'").select("program_id", F.col("label").alias("node"))
    return fixpoint.reach_by_key(e, seeds, "program_id").select("program_id", "node")


@query("rg05_entry_depths", derived.oracle("SELECT program_id, node, min(depth) AS depth FROM walk GROUP BY program_id, node",
  "walk AS (SELECT program_id, label AS node, 0 AS depth FROM blk WHERE block_ord = 0 UNION SELECT e.program_id, e.dst, w.depth + 1 FROM walk w JOIN edge e ON e.program_id = w.program_id AND e.src = w.node WHERE w.depth < 64)"))
def entry_depths(spark, sf):
    """The same by rounds of joins over all programs at once."""
    _, b, e = _graph(spark, sf)
    return fixpoint.reach(b.where("block_ord = 0").select("program_id", F.col("label").alias("node")), e, ["program_id"])


@query("rg07_call_targets", derived.oracle("SELECT program_id, 'f' || first_event AS name, label FROM fn"))
def call_targets(spark, sf):
    b = cfg.blocks(_placed(spark, sf)).where("label like 'L%'")
    return b.groupBy("program_id", F.concat(F.lit("f"), F.substring("label", 2, 30)).alias("name")).agg(F.min_by("label", "block_ord").alias("label"))


@query("rg08_mermaid_shapes", derived.oracle("""
SELECT program_id, label, CASE WHEN block_ord = 0 OR last_op = 'RETURN' THEN 'stadium' WHEN last_op = 'BRANCH_IF' THEN 'rhombus' ELSE 'box' END AS shape,
  CAST(CASE WHEN n_instr > 6 THEN 6 ELSE n_instr END AS INT) AS shown FROM blk"""))
def mermaid(spark, sf):
    p = _placed(spark, sf)
    m = cfg.mermaid_nodes(p, cfg.blocks(p))
    return m.select("program_id", "label", "shape", F.when(F.col("lines") == "", 0).otherwise(F.size(F.split("lines", "\n"))).alias("shown"))


@query("rg10_block_owners", derived.oracle("SELECT program_id, label, block_ord, func FROM own"))
def owners(spark, sf):
    return cfg.owners(cfg.blocks(_placed(spark, sf)), F.col("label").startswith("L"))


_CFG_CLOSURE = "clo AS (SELECT program_id, src, dst FROM edge UNION SELECT c.program_id, c.src, e.dst FROM clo c JOIN edge e ON e.program_id = c.program_id AND e.src = c.dst)"


@query("rg11_scc", derived.oracle("""
SELECT n.program_id, n.node, least(n.node, coalesce(min(a.dst), n.node)) AS scc FROM (SELECT program_id, src AS node FROM edge UNION SELECT program_id, dst FROM edge) n
LEFT JOIN (SELECT a.* FROM clo a JOIN clo b ON a.program_id = b.program_id AND a.src = b.dst AND a.dst = b.src) a ON a.program_id = n.program_id AND a.src = n.node GROUP BY n.program_id, n.node""", _CFG_CLOSURE))
def scc(spark, sf):
    return fixpoint.components_by_key(_graph(spark, sf)[2], "program_id")


@query("rg12_transpose", derived.oracle("SELECT program_id, dst AS src, src AS dst FROM edge"))
def transpose(spark, sf):
    return _graph(spark, sf)[2].select("program_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


@query("rg14_cfg_closure", derived.oracle("SELECT program_id, src, dst FROM clo", _CFG_CLOSURE))
def cfg_closure(spark, sf):
    return fixpoint.closure_by_key(_graph(spark, sf)[2], "program_id")


@query("rg16_cycle_nodes", derived.oracle("SELECT program_id, src AS node FROM clo WHERE src = dst", _CFG_CLOSURE))
def cycle_nodes(spark, sf):
    return fixpoint.closure_by_key(_graph(spark, sf)[2], "program_id").where("src = dst").select("program_id", F.col("src").alias("node"))


@query("rd01_definitions", derived.oracle("SELECT var, count(*) AS n, count(DISTINCT program_id) AS programs FROM def WHERE var LIKE 'v%' GROUP BY var"))
def definitions(spark, sf):
    return cfg.writes(_placed(spark, sf)).where("var like 'v%'").groupBy("var").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("program_id").alias("programs"))


@query("rd02_gen", derived.oracle("SELECT program_id, block, var, idx FROM gen"))
def gen(spark, sf):
    return dataflow.gen(cfg.writes(_placed(spark, sf)))


@query("rd03_kill", derived.oracle("SELECT a.program_id, a.block, a.var, b.block AS def_block, b.idx AS def_idx FROM gen a JOIN gen b ON a.program_id = b.program_id AND a.var = b.var AND a.block <> b.block"))
def kill(spark, sf):
    return dataflow.kill(dataflow.gen(cfg.writes(_placed(spark, sf))))


_REACHING = """rin AS (
  SELECT e.program_id, e.dst AS block, g.var, g.block AS def_block, g.idx AS def_idx FROM edge e JOIN gen g ON g.program_id = e.program_id AND g.block = e.src
  UNION SELECT e.program_id, e.dst, r.var, r.def_block, r.def_idx FROM rin r JOIN edge e ON e.program_id = r.program_id AND e.src = r.block
    WHERE NOT EXISTS (SELECT 1 FROM gen g WHERE g.program_id = r.program_id AND g.block = r.block AND g.var = r.var))"""


def _reaching(spark, sf):
    p, _, e = _graph(spark, sf)
    w = cfg.writes(p)
    return p, w, dataflow.reaching(dataflow.gen(w), e)


@query("rd04_reaching_definitions", derived.oracle("SELECT program_id, block, var, def_block, def_idx FROM rin", _REACHING))
def reaching(spark, sf):
    return _reaching(spark, sf)[2]


@query("rd05_def_use", derived.oracle("""
SELECT u.program_id, u.var, u.block AS def_block, max(d.idx) AS def_idx, u.block AS use_block, u.idx AS use_idx FROM (SELECT DISTINCT * FROM use) u
JOIN def d ON d.program_id = u.program_id AND d.block = u.block AND d.var = u.var AND d.idx < u.idx GROUP BY u.program_id, u.var, u.block, u.idx
UNION ALL SELECT u.program_id, u.var, r.def_block, r.def_idx, u.block, u.idx FROM (SELECT DISTINCT * FROM use) u JOIN rin r ON r.program_id = u.program_id AND r.block = u.block AND r.var = u.var
WHERE NOT EXISTS (SELECT 1 FROM def d WHERE d.program_id = u.program_id AND d.block = u.block AND d.var = u.var AND d.idx < u.idx)""", _REACHING))
def def_use(spark, sf):
    p, w, r = _reaching(spark, sf)
    return dataflow.def_use(w, cfg.reads(p), r)


_PRODUCED = "SELECT DISTINCT d.program_id, d.var, u.var AS source FROM def d JOIN use u ON u.program_id = d.program_id AND u.block = d.block AND u.idx = d.idx"


@query("rd06_produced_from", derived.oracle(_PRODUCED))
def produced_from(spark, sf):
    p = _placed(spark, sf)
    return dataflow.produced_from(cfg.writes(p), cfg.reads(p))


_TRACE = f"""prod AS ({_PRODUCED}), tr AS (
  SELECT program_id, var AS reg, source FROM prod WHERE var LIKE '\\%%' ESCAPE '\\' UNION SELECT t.program_id, t.reg, p.source FROM tr t JOIN prod p ON p.program_id = t.program_id AND p.var = t.source WHERE t.source LIKE '\\%%' ESCAPE '\\')"""
_DEPS = _TRACE + ", dep AS (SELECT DISTINCT i.program_id, i.var AS src, t.source AS dst FROM ins i JOIN tr t ON t.program_id = i.program_id AND t.reg = i.p1 WHERE i.opcode = 'STORE_VAR' AND t.source LIKE 'v%')"
_DEPCLO = _DEPS + ", dclo AS (SELECT program_id, src, dst FROM dep UNION SELECT c.program_id, c.src, d.dst FROM dclo c JOIN dep d ON d.program_id = c.program_id AND d.src = c.dst)"


def _sources(spark, sf):
    p = _placed(spark, sf)
    return p, dataflow.named_sources(dataflow.produced_from(cfg.writes(p), cfg.reads(p)))


def _closure(spark, sf):
    return fixpoint.once("dependencies", lambda: fixpoint.closure_by_key(dataflow.raw_dependencies(*_sources(spark, sf)), "program_id"))


@query("rd07_trace_named", derived.oracle("SELECT program_id, reg, source AS var FROM tr WHERE source LIKE 'v%'", _TRACE))
def trace_named(spark, sf):
    return _sources(spark, sf)[1]


@query("rd08_raw_dependencies", derived.oracle("SELECT program_id, src, dst FROM dep", _DEPS))
def raw_dependencies(spark, sf):
    return dataflow.raw_dependencies(*_sources(spark, sf))


@query("rd09_dependency_graph", derived.oracle("SELECT program_id, src, dst FROM dclo", _DEPCLO))
def dependency_graph(spark, sf):
    return fixpoint.closure_by_key(dataflow.raw_dependencies(*_sources(spark, sf)), "program_id")


@query("rg13_dependency_rounds", derived.oracle("SELECT program_id, src, dst FROM dclo", _DEPCLO))
def dependency_rounds(spark, sf):
    """The same closure by rounds of joins over all programs at once."""
    return fixpoint.closure(dataflow.raw_dependencies(*_sources(spark, sf)), ["program_id"])


def _sites(spark, sf):
    p = _placed(spark, sf)
    b = fixpoint.once("blocks", lambda: cfg.blocks(p))
    own = cfg.owners(b, F.col("label").startswith("L")).select("program_id", F.col("label").alias("block"), F.col("func").alias("caller"))
    w = Window.partitionBy("program_id").orderBy("block_ord")
    funcs = b.where("label like 'L%'").withColumn("num", F.row_number().over(w) - 1).select("program_id", "label", F.col("block_ord").alias("ord"), "num", F.concat(F.lit("f"), F.substring("label", 2, 30)).alias("name"))
    n = funcs.groupBy("program_id").agg(F.count(F.lit(1)).alias("n"))
    calls = p.where("opcode = 'LOAD_VAR' and pmod(k, 5) = 0").join(n, "program_id").join(own, ["program_id", "block"]).withColumn("num", F.pmod("k", F.col("n")))
    named = calls.join(funcs.select("program_id", "num", F.col("name").alias("target")), ["program_id", "num"])
    return funcs, fixpoint.once("sites", lambda: interproc.resolve_functions(named.select("program_id", "caller", "block", "idx", "target"), funcs))


@query("ri01_function_entries", derived.oracle("SELECT program_id, label, num FROM fn"))
def function_entries(spark, sf):
    return _sites(spark, sf)[0].select("program_id", "label", "num")


@query("ri02_resolved_calls", derived.oracle("SELECT program_id, caller, block, idx, callee FROM site"))
def resolved_calls(spark, sf):
    return _sites(spark, sf)[1].where("caller is not null").select("program_id", "caller", "block", "idx", "callee")


_CALLS = "calls AS (SELECT DISTINCT program_id, caller AS src, callee AS dst FROM site)"
_CALLCLO = _CALLS + ", cclo AS (SELECT program_id, src, dst FROM calls UNION SELECT c.program_id, c.src, e.dst FROM cclo c JOIN calls e ON e.program_id = c.program_id AND e.src = c.dst)"


@query("ri05_call_graph", derived.oracle("SELECT program_id, src, dst FROM calls", _CALLS))
def call_graph(spark, sf):
    return interproc.call_edges(_sites(spark, sf)[1])


@query("ri03_class_hierarchy_calls", derived.oracle("SELECT s.program_id, s.caller, s.block, s.idx, f.label AS callee FROM site s JOIN fn f ON f.program_id = s.program_id AND f.num % 3 = (SELECT num % 3 FROM fn g WHERE g.program_id = s.program_id AND g.label = s.callee)"))
def class_hierarchy_calls(spark, sf):
    """Method calls: functions with the same number mod 3 define the same method name in different classes; all of them are callees."""
    funcs, sites = _sites(spark, sf)
    methods = funcs.select("program_id", F.col("label").alias("class"), F.pmod("num", F.lit(3)).alias("method"), F.col("label").alias("func"))
    named = sites.where("caller is not null").join(methods.select("program_id", F.col("func").alias("callee"), "method"), ["program_id", "callee"]).drop("callee")
    return interproc.resolve_methods(named, methods).select("program_id", "caller", "block", "idx", F.col("func").alias("callee"))


@query("rg20_callers_callees", derived.oracle("""SELECT f.program_id, f.label, count(DISTINCT i.src) AS callers, count(DISTINCT o.dst) AS callees FROM fn f
LEFT JOIN calls i ON i.program_id = f.program_id AND i.dst = f.label LEFT JOIN calls o ON o.program_id = f.program_id AND o.src = f.label GROUP BY f.program_id, f.label""", _CALLS))
def callers_callees(spark, sf):
    funcs, sites = _sites(spark, sf)
    e = interproc.call_edges(sites)
    ins = e.groupBy("program_id", F.col("dst").alias("label")).agg(F.count(F.lit(1)).alias("callers"))
    outs = e.groupBy("program_id", F.col("src").alias("label")).agg(F.count(F.lit(1)).alias("callees"))
    j = funcs.select("program_id", "label").join(ins, ["program_id", "label"], "left").join(outs, ["program_id", "label"], "left")
    return j.select("program_id", "label", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


@query("rg21_top_level_calls", derived.oracle("SELECT i.program_id, i.block, i.idx FROM ins i JOIN own ON own.program_id = i.program_id AND own.label = i.block WHERE i.opcode = 'LOAD_VAR' AND i.k % 5 = 0 AND own.func IS NULL AND i.program_id IN (SELECT program_id FROM fn)"))
def top_level_calls(spark, sf):
    return _sites(spark, sf)[1].where("caller is null").select("program_id", "block", "idx")


@query("ri16_call_closure", derived.oracle("SELECT program_id, src, dst FROM cclo", _CALLCLO))
def call_closure(spark, sf):
    return fixpoint.closure_by_key(interproc.call_edges(_sites(spark, sf)[1]), "program_id")


@query("ri18_impact_of_v0", derived.oracle("SELECT program_id, dst AS node FROM dclo WHERE src = 'v0'", _DEPCLO))
def impact(spark, sf):
    return interproc.impact_of(_closure(spark, sf), "v0")


@query("ri19_backward_slice_v1", derived.oracle("SELECT program_id, src AS node FROM dclo WHERE dst = 'v1' AND src <> 'v1'", _DEPCLO))
def backward_slice(spark, sf):
    return interproc.backward_slice(_closure(spark, sf), "v1")


@query("ri20_taint_reaches", derived.oracle("SELECT program_id, src AS source, dst AS sink FROM dclo WHERE src IN ('v0', 'v1') AND dst IN ('v6', 'v7')", _DEPCLO))
def taint(spark, sf):
    c = _closure(spark, sf)
    nodes = c.select("program_id").distinct()
    pick = lambda *names: nodes.select("program_id", F.explode(F.array(*map(F.lit, names))).alias("node"))
    return interproc.taint_pairs(c, pick("v0", "v1"), pick("v6", "v7"))


@query("ri21_taint_paths", derived.oracle("SELECT program_id, node, hops FROM (SELECT program_id, node, min(hops) AS hops FROM tp GROUP BY program_id, node)",
  _DEPS + ", tp AS (SELECT DISTINCT program_id, 'v0' AS node, 0 AS hops FROM dep UNION SELECT d.program_id, d.dst, t.hops + 1 FROM tp t JOIN dep d ON d.program_id = t.program_id AND d.src = t.node WHERE t.hops < 9)"))
def taint_paths(spark, sf):
    raw = raw_dependencies(spark, sf)
    raw = fixpoint.checkpointed(raw)
    starts = raw.select("program_id").distinct().withColumn("node", F.lit("v0"))
    return fixpoint.shortest_paths(raw, starts, ["program_id"]).select("program_id", "node", (F.size("path") - 1).alias("hops"))


@query("ri23_program_overview", derived.oracle("""SELECT c.program_id, c.n AS blocks, coalesce(f.n, 0) AS functions, coalesce(e.n, 0) AS edges, coalesce(k.n, 0) AS calls FROM cnt c LEFT JOIN nf f USING (program_id)
LEFT JOIN (SELECT program_id, count(*) AS n FROM edge GROUP BY program_id) e USING (program_id) LEFT JOIN (SELECT program_id, count(*) AS n FROM site GROUP BY program_id) k USING (program_id)"""))
def overview(spark, sf):
    p, b, e = _graph(spark, sf)
    funcs, sites = _sites(spark, sf)
    out = b.groupBy("program_id").agg(F.count(F.lit(1)).alias("blocks"), F.count(F.when(F.col("label").startswith("L"), 1)).alias("functions"))
    for name, t in (("edges", e), ("calls", sites.where("caller is not null"))):
        out = out.join(t.groupBy("program_id").agg(F.count(F.lit(1)).alias(name)), "program_id", "left")
    return out.select("program_id", "blocks", "functions", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("calls", F.lit(0)).alias("calls"))


@query("ri25_call_trees", derived.oracle("SELECT r.program_id, r.block, r.idx, t.path, t.depth, t.recursive FROM roots r JOIN tree t ON t.program_id = r.program_id AND t.root = r.root", _CALLS + """, roots AS (
  SELECT program_id, CAST(NULL AS VARCHAR) AS block, CAST(NULL AS INT) AS idx, label AS root FROM fn WHERE num = 0
  UNION ALL SELECT i.program_id, i.block, i.idx, fn.label FROM ins i JOIN own ON own.program_id = i.program_id AND own.label = i.block AND own.func IS NULL
    JOIN nf ON nf.program_id = i.program_id JOIN fn ON fn.program_id = i.program_id AND fn.num = i.k % nf.n WHERE i.opcode = 'LOAD_VAR' AND i.k % 5 = 0
), tree AS (
  SELECT DISTINCT program_id, root, root AS path, [root] AS seen, root AS last, 0 AS depth, FALSE AS recursive FROM roots
  UNION ALL SELECT t.program_id, t.root, t.path || ' > ' || c.dst, list_append(t.seen, c.dst), c.dst, t.depth + 1, list_contains(t.seen, c.dst) FROM tree t JOIN calls c ON c.program_id = t.program_id AND c.src = t.last WHERE NOT t.recursive)"""))
def call_trees(spark, sf):
    """The tree of each top-level call (block, idx), and of each program's first function as the given one (block and idx null)."""
    funcs, sites = _sites(spark, sf)
    given = funcs.where("num = 0").select("program_id", F.lit(None).cast("string").alias("block"), F.lit(None).cast("int").alias("idx"), F.col("label").alias("root"))
    top = sites.where("caller is null and callee is not null").select("program_id", "block", F.col("idx").cast("int"), F.col("callee").alias("root"))
    roots = fixpoint.checkpointed(given.union(top))
    trees = interproc.call_trees(interproc.call_edges(sites), roots.withColumnRenamed("root", "node"))
    return roots.join(trees, ["program_id", "root"]).select("program_id", "block", "idx", "path", "depth", "recursive")


_SHAPES = "sh AS (SELECT b.program_id, count(*) AS blocks, (SELECT count(*) FROM edge e WHERE e.program_id = b.program_id) AS edges FROM blk b GROUP BY b.program_id)"


@query("ra04_cfg_shapes", derived.oracle("SELECT program_id % 10 AS family, min(blocks) AS min_blocks, max(blocks) AS max_blocks, min(edges) AS min_edges, max(edges) AS max_edges, count(DISTINCT (blocks, edges)) AS shapes FROM sh GROUP BY program_id % 10", _SHAPES))
def cfg_shapes(spark, sf):
    s = overview(spark, sf)
    return s.groupBy(F.pmod("program_id", F.lit(10)).alias("family")).agg(F.min("blocks").alias("min_blocks"), F.max("blocks").alias("max_blocks"), F.min("edges").alias("min_edges"), F.max("edges").alias("max_edges"), F.countDistinct(F.struct("blocks", "edges")).alias("shapes"))


@query("ra05_structural_classes", derived.oracle("""
SELECT family, blocks, edges, members, dense_rank() OVER (PARTITION BY family ORDER BY members DESC, blocks, edges) AS class
FROM (SELECT program_id % 10 AS family, blocks, edges, count(*) AS members FROM sh GROUP BY ALL)""", _SHAPES))
def structural_classes(spark, sf):
    s = overview(spark, sf).groupBy(F.pmod("program_id", F.lit(10)).alias("family"), "blocks", "edges").agg(F.count(F.lit(1)).alias("members"))
    return s.withColumn("class", F.dense_rank().over(Window.partitionBy("family").orderBy(F.desc("members"), "blocks", "edges")))


@query("ra08_step_deltas", derived.oracle("SELECT program_id, n - min(n) OVER (PARTITION BY program_id % 10) AS delta FROM (SELECT program_id, count(*) AS n FROM ins GROUP BY program_id)"))
def step_deltas(spark, sf):
    s = derived.instr(spark, sf).groupBy("program_id").agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumn("family", F.pmod("program_id", F.lit(10)))
    least = s.groupBy("family").agg(F.min("n").alias("least"))  # ten rows
    return s.join(F.broadcast(least), "family").select("program_id", (F.col("n") - F.col("least")).alias("delta"))


@query("ra09_opcode_sequences", derived.oracle("SELECT program_id, md5(string_agg(opcode, ',' ORDER BY pc)) AS sequence FROM ins WHERE opcode <> 'LABEL' GROUP BY program_id"))
def opcode_sequences(spark, sf):
    i = derived.instr(spark, sf).where("opcode <> 'LABEL'")
    op = F.when(F.col("opcode") == "DECL_VAR", "STORE_VAR").otherwise(F.col("opcode"))
    s = i.groupBy("program_id").agg(F.array_sort(F.collect_list(F.struct("pc", op.alias("op")))).alias("s"))
    return s.select("program_id", F.md5(F.array_join(F.transform("s", lambda x: x["op"]), ",").cast("binary")).alias("sequence"))


@query("ra10_common_opcodes", derived.oracle("SELECT opcode FROM ins GROUP BY opcode HAVING count(DISTINCT program_id) = (SELECT count(DISTINCT program_id) FROM ins)"))
def common_opcodes(spark, sf):
    i = derived.instr(spark, sf)
    n = i.select("program_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    return i.groupBy("opcode").agg(F.countDistinct("program_id").alias("p")).join(F.broadcast(n), F.col("p") == F.col("n")).select("opcode")


@query("ra11_variance_guard", derived.oracle("SELECT family, median(n) AS median_n, max(n) <= 5 * median(n) AS ok FROM (SELECT program_id % 10 AS family, count(*) AS n FROM ins GROUP BY program_id) GROUP BY family"))
def variance_guard(spark, sf):
    s = derived.instr(spark, sf).groupBy("program_id").agg(F.count(F.lit(1)).alias("n"))
    m = F.median("n")
    return s.groupBy(F.pmod("program_id", F.lit(10)).alias("family")).agg(m.alias("median_n"), (F.max("n") <= 5 * m).alias("ok"))


@query("ra12_coverage_matrix", derived.oracle("SELECT program_id % 10 AS family, " + ", ".join(f"count(*) FILTER (opcode = '{o}') AS {o.lower()}" for o in ("LABEL", "LOAD_VAR", "BINOP", "STORE_VAR", "BRANCH_IF", "BRANCH", "RETURN")) + " FROM ins GROUP BY program_id % 10"))
def coverage_matrix(spark, sf):
    names = ("LABEL", "LOAD_VAR", "BINOP", "STORE_VAR", "BRANCH_IF", "BRANCH", "RETURN")
    m = derived.instr(spark, sf).groupBy(F.pmod("program_id", F.lit(10)).alias("family")).pivot("opcode", list(names)).count().na.fill(0)
    return m.select("family", *[F.col(o).alias(o.lower()) for o in names])


@query("rl03_register_rebase", derived.oracle("""
SELECT program_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY program_id % 16 ORDER BY program_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base
FROM (SELECT program_id, count(*) FILTER (result_reg IS NOT NULL) AS n FROM ins GROUP BY program_id)"""))
def register_rebase(spark, sf):
    """Programs of one project (number mod 16) linked in order: registers of each start after those of the earlier ones."""
    s = derived.instr(spark, sf).groupBy("program_id").agg(F.count("result_reg").alias("n"))
    w = Window.partitionBy(F.pmod("program_id", F.lit(16))).orderBy("program_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("program_id", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))


@query("rl08_exports", derived.oracle("SELECT DISTINCT i.program_id, i.var AS name FROM ins i JOIN own ON own.program_id = i.program_id AND own.label = i.block WHERE i.opcode = 'STORE_VAR' AND own.func IS NULL UNION ALL SELECT program_id, 'f' || first_event FROM fn"))
def exports(spark, sf):
    """Functions, and variables stored outside them."""
    p = _placed(spark, sf)
    b = cfg.blocks(p)
    top = cfg.owners(b, F.col("label").startswith("L")).where("func is null").select("program_id", F.col("label").alias("block"))
    variables = p.where("opcode = 'STORE_VAR'").join(top, ["program_id", "block"], "left_semi").select("program_id", F.get("operands", F.lit(0)).alias("name")).distinct()
    return variables.union(b.where("label like 'L%'").select("program_id", F.concat(F.lit("f"), F.substring("label", 2, 30))))
