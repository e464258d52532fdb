"""More registered queries: parameter flows, sub-graphs, inference, linking, reports and dumps, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import cfg, dataflow, inference, interproc, link
from sparkloom.plans import derived, fixpoint
from sparkloom.plans import program_queries as P
from sparkloom.plans.schema import values_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = fixpoint.scoped(f)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# function f<event> has parameters v<event % 8> and v<(event + 1) % 8> and returns v<(event + 2) % 8>; a call site passes v<k % 8>, v<(k + 1) % 8> and stores to v<(k + 2) % 8>
_FLOW = P._DEPCLO + """, par AS (SELECT program_id, label AS func, p.pos, 'v' || ((first_event + p.pos) % 8) AS param FROM fn, (VALUES (0), (1)) p(pos)),
ret AS (SELECT program_id, label AS func, 'v' || ((first_event + 2) % 8) AS var FROM fn),
summ AS (SELECT DISTINCT par.program_id, par.func, par.param, par.pos FROM par JOIN ret USING (program_id, func) WHERE EXISTS (SELECT 1 FROM dclo d WHERE d.program_id = par.program_id AND d.src = ret.var AND d.dst = par.param)),
act AS (SELECT DISTINCT s.program_id, 'v' || ((i.k + m.pos) % 8) AS src, 'v' || ((i.k + 2) % 8) AS dst FROM site s JOIN ins i ON i.program_id = s.program_id AND i.block = s.block AND i.idx = s.idx JOIN summ m ON m.program_id = s.program_id AND m.func = s.callee)"""


def _var(n):
    return F.concat(F.lit("v"), F.pmod(n, F.lit(8)).cast("string"))


def _flows(spark, sf):
    funcs, sites = P._sites(spark, sf)
    dep = fixpoint.checkpointed(P.dependency_graph(spark, sf))
    event = F.substring("name", 2, 30).cast("bigint")
    params = funcs.select("program_id", F.col("label").alias("func"), F.posexplode(F.array(_var(event), _var(event + 1))).alias("pos", "param"))
    returns = funcs.select("program_id", F.col("label").alias("func"), _var(event + 2).alias("var"))
    return funcs, sites, dep, params, interproc.param_returns(dep, params, returns)


@query("ri06_parameters", derived.oracle("SELECT program_id, func, pos, param FROM par", _FLOW))
def parameters(spark, sf):
    return _flows(spark, sf)[3].select("program_id", "func", "pos", "param")


@query("ri10_param_returns", derived.oracle("SELECT program_id, func, param FROM summ", _FLOW))
def param_returns(spark, sf):
    return _flows(spark, sf)[4]


def _actual(spark, sf):
    funcs, sites, dep, params, summary = _flows(spark, sf)
    k = P._placed(spark, sf).select("program_id", "block", "idx", "k")
    at = sites.where("caller is not null").join(k, ["program_id", "block", "idx"]).select("program_id", "callee", F.array(_var(F.col("k")), _var(F.col("k") + 1)).alias("args"), _var(F.col("k") + 2).alias("result"))
    return dep, interproc.substitute(summary, params, at)


@query("ri15_call_site_flows", derived.oracle("SELECT program_id, src, dst FROM act", _FLOW))
def call_site_flows(spark, sf):
    return _actual(spark, sf)[1]


@query("ri16_whole_program_flows", derived.oracle("SELECT program_id, src, dst FROM wclo", _FLOW + ", wp AS (SELECT program_id, src, dst FROM act UNION SELECT program_id, dst, src FROM dep), wclo AS (SELECT program_id, src, dst FROM wp UNION SELECT c.program_id, c.src, e.dst FROM wclo c JOIN wp e ON e.program_id = c.program_id AND e.src = c.dst)"))
def whole_program_flows(spark, sf):
    """Flows from what is read to what is computed from it, through calls: closed a program."""
    raw = P.raw_dependencies(spark, sf).select("program_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return fixpoint.closure_by_key(_actual(spark, sf)[1].union(raw).distinct(), "program_id")


@query("ri24_function_report", derived.oracle("""SELECT f.program_id, f.label, (SELECT count(*) FROM calls c WHERE c.program_id = f.program_id AND c.dst = f.label) AS callers, (SELECT count(*) FROM calls c WHERE c.program_id = f.program_id AND c.src = f.label) AS callees,
  (SELECT count(*) FROM summ s WHERE s.program_id = f.program_id AND s.func = f.label) AS param_to_return FROM fn f""", _FLOW + ", " + P._CALLS))
def function_report(spark, sf):
    s = _flows(spark, sf)[4].groupBy("program_id", F.col("func").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    j = P.callers_callees(spark, sf).join(s, ["program_id", "label"], "left")
    return j.select("program_id", "label", "callers", "callees", F.coalesce("n", F.lit(0)).alias("param_to_return"))


@query("ri26_find_function", derived.oracle("SELECT program_id, 'f' || first_event AS target, label AS callee FROM fn UNION ALL SELECT program_id, label, label FROM fn"))
def find_function(spark, sf):
    funcs = P._sites(spark, sf)[0]
    wanted = funcs.select("program_id", F.col("name").alias("target")).union(funcs.select("program_id", "label"))
    return interproc.resolve_functions(wanted, funcs).select("program_id", "target", "callee")


@query("ri28_rendered_graph", derived.oracle("SELECT program_id, 'var ' || src || ' <- var ' || dst AS line FROM dep", P._DEPS))
def rendered_graph(spark, sf):
    d = P.raw_dependencies(spark, sf)
    return d.select("program_id", F.concat(F.lit("var "), "src", F.lit(" <- var "), "dst").alias("line"))


@query("rg09_function_blocks", derived.oracle("SELECT program_id, func, node FROM sub", "sub AS (SELECT program_id, label AS func, label AS node FROM fn UNION SELECT s.program_id, s.func, e.dst FROM sub s JOIN edge e ON e.program_id = s.program_id AND e.src = s.node WHERE NOT EXISTS (SELECT 1 FROM fn f WHERE f.program_id = e.program_id AND f.label = e.dst))"))
def function_blocks(spark, sf):
    """Blocks reached from each function's entry without passing another function's."""
    _, b, e = P._graph(spark, sf)
    inner = e.where("not dst like 'L%'").select("program_id", "src", "dst")
    seeds = b.where("label like 'L%'").select("program_id", F.col("label").alias("func"), F.col("label").alias("node"))

    def solve(rows):
        adj: dict = {}
        for s, d in rows:
            if d is not None:
                adj.setdefault(s, []).append(d)
        for f in [s for s, d in rows if d is None]:
            seen, todo = {f}, [f]
            while todo:
                for d in adj.get(todo.pop(), ()):
                    if d not in seen:
                        seen.add(d)
                        todo.append(d)
            yield from ((f, n) for n in seen)

    both = inner.union(seeds.select("program_id", "func", F.lit(None).cast("string")))
    return fixpoint.per_key(both, "program_id", solve, "program_id bigint, func string, node string")


@query("rd10_analysis_bundle", derived.oracle("""SELECT c.program_id, (SELECT count(*) FROM def x WHERE x.program_id = c.program_id) AS definitions, (SELECT count(*) FROM gen x WHERE x.program_id = c.program_id) AS gen,
  (SELECT count(*) FROM rin x WHERE x.program_id = c.program_id) AS reaching, (SELECT count(*) FROM dep x WHERE x.program_id = c.program_id) AS dependencies FROM cnt c""", P._REACHING + ", " + P._DEPS))
def analysis_bundle(spark, sf):
    p, w, r = P._reaching(spark, sf)
    out = p.select("program_id").distinct()
    for name, t in (("definitions", w), ("gen", dataflow.gen(w)), ("reaching", r), ("dependencies", P.raw_dependencies(spark, sf))):
        out = out.join(t.groupBy("program_id").agg(F.count(F.lit(1)).alias(name)), "program_id", "left")
    return out.na.fill(0)


_SEEDS = {f"v{i}": ("Float" if i % 2 else "Int") for i in range(derived.VARIABLES)}


@query("rt01_type_inference", derived.oracle("""SELECT w.program_id, w.var AS name, CASE WHEN max(CASE WHEN t.source LIKE 'v%' AND CAST(substr(t.source, 2) AS INT) % 2 = 1 THEN 1 ELSE 0 END) = 1 THEN 'Float' ELSE 'Int' END AS type
FROM def w LEFT JOIN tr t ON t.program_id = w.program_id AND t.reg = w.var WHERE w.var LIKE '%\\%%' ESCAPE '\\' AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.program_id = w.program_id AND b.reg = w.var)
  AND NOT EXISTS (SELECT 1 FROM tr x JOIN bad b ON b.program_id = x.program_id AND b.reg = x.source WHERE x.program_id = w.program_id AND x.reg = w.var) GROUP BY w.program_id, w.var""", P._TRACE + ", bad AS (SELECT program_id, result_reg AS reg FROM ins WHERE opcode = 'BINOP' AND p2 IS NULL)"))
def type_inference(spark, sf):
    """Types of registers from seeded variable types."""
    t = inference.infer(derived.instr(spark, sf), _SEEDS)
    return t.where("name like '\\%%'")


@query("ra06_class_members", derived.oracle("SELECT family, blocks, edges, string_agg(program_id, ',' ORDER BY program_id) AS members FROM (SELECT program_id % 10 AS family, program_id, blocks, edges FROM sh) GROUP BY family, blocks, edges", P._SHAPES))
def class_members(spark, sf):
    s = P.overview(spark, sf).groupBy(F.pmod("program_id", F.lit(10)).alias("family"), "blocks", "edges").agg(F.array_sort(F.collect_list("program_id")).alias("m"))
    return s.select("family", "blocks", "edges", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query("ra07_audit_rollup", derived.oracle("SELECT program_id % 10 AS family, opcode, count(*) AS n FROM ins GROUP BY ROLLUP (program_id % 10, opcode)"))
def audit_rollup(spark, sf):
    i = derived.instr(spark, sf).withColumn("family", F.pmod("program_id", F.lit(10)))
    return i.rollup("family", "opcode").agg(F.count(F.lit(1)).alias("n"))


@query("rp12_validated_programs", derived.oracle("SELECT program_id, count(*) > 0 AS has_code, arg_min(opcode, pc) = 'LABEL' AS has_entry FROM ins GROUP BY program_id"))
def validated(spark, sf):
    i = derived.instr(spark, sf)
    return i.groupBy("program_id").agg((F.count(F.lit(1)) > 0).alias("has_code"), (F.min_by("opcode", "pc") == "LABEL").alias("has_entry"))


@query("rl01_module_prefixes", r"SELECT page_id, replace(regexp_replace(ltrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), '\.[A-Za-z0-9]+$', ''), '/', '.') AS prefix FROM pages")
def module_prefixes(spark, sf):
    return table(spark, sf, "pages").select("page_id", link.module_prefix(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)).alias("prefix"))


@query("rl07_linked_program", derived.oracle("""SELECT program_id % 16 AS project, CAST(row_number() OVER (PARTITION BY program_id % 16 ORDER BY program_id, pc) - 1 AS BIGINT) AS linked_pc, program_id, opcode,
  CASE WHEN opcode = 'LABEL' THEN 'm' || program_id || '.L' || event_id ELSE '' END AS label FROM ins"""))
def linked_program(spark, sf):
    """Programs of a project (number mod 16) linked in order."""
    i = derived.instr(spark, sf)
    order = i.select("program_id").distinct().select(F.pmod("program_id", F.lit(16)).alias("project"), "program_id", F.col("program_id").alias("place"))
    return link.link(i, order)


@query("rl13_entry_points", derived.oracle("SELECT program_id, min_by(label, num) AS entry, count(*) AS functions FROM fn GROUP BY program_id"))
def entry_points(spark, sf):
    funcs = P._sites(spark, sf)[0]
    return funcs.groupBy("program_id").agg(F.min_by("label", "num").alias("entry"), F.count(F.lit(1)).alias("functions"))


@query("rs17_graph_text", derived.oracle("SELECT program_id, md5(string_agg(src || ' -> ' || dst, chr(10) ORDER BY src || ' -> ' || dst)) AS text FROM edge GROUP BY program_id"))
def graph_text(spark, sf):
    e = P._graph(spark, sf)[2].select("program_id", F.concat("src", F.lit(" -> "), "dst").alias("line"))
    t = e.groupBy("program_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    return t.select("program_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("rs07_json_documents", "SELECT user_id, CAST(sum(CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY user_id")
def json_documents(spark, sf):
    """Parsed documents: a typed view of their JSON."""
    e = table(spark, sf, "events").withColumn("doc", F.from_json("props", "k bigint"))
    return e.groupBy("user_id").agg(F.sum("doc.k").alias("total"), F.count(F.lit(1)).alias("n"))


@query("rx01_move", "SELECT c_custkey, rpad(left(c_name, 10), 10, ' ') AS short, right(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 4) AS digits, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS wide FROM customer")
def move(spark, sf):
    """Moves between fields: text is cut or padded on the right, digits on the left."""
    k = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select("c_custkey", F.rpad("c_name", 10, " ").alias("short"), F.right(F.lpad(k, 8, "0"), F.lit(4)).alias("digits"), F.lpad(k, 8, "0").alias("wide"))


@query("rx03_compute", "SELECT o_orderkey, CAST(floor((o_orderkey * 3 + 7) / 2.0) AS BIGINT) AS value, CAST(o_orderkey * o_custkey AS BIGINT) AS product FROM orders")
def compute(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.floor((k * 3 + 7) / 2).alias("value"), (k * F.col("o_custkey")).alias("product"))


@query("rx05_conditions", "SELECT c_custkey, rtrim(c_mktsegment) = 'BUILDING' AS named, c_acctbal < 0 AS negative, c_custkey BETWEEN 10 AND 20 OR c_custkey = 50 AS in_range, NOT (c_acctbal > 0 AND c_custkey > 5) AS neither FROM customer")
def conditions(spark, sf):
    """Comparison without trailing spaces, sign, named values and ranges, and their combinations."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", (F.rtrim("c_mktsegment") == "BUILDING").alias("named"), (b < 0).alias("negative"), (k.between(10, 20) | (k == 50)).alias("in_range"), (~((b > 0) & (k > 5))).alias("neither"))


@query("rg06_subgraph_ranges", derived.oracle("SELECT f.program_id, 'func_f' || f.first_event || '_0' AS start_label, 'end_f' || f.first_event || '_1' AS end_label FROM fn f"))
def subgraph_ranges(spark, sf):
    """Every function's label paired with the first later end label of its name."""
    p = P._placed(spark, sf)
    lab = p.where("opcode = 'LABEL'").select("program_id", (F.col("pc") * 2).alias("pc"), "opcode", F.concat(F.lit("func_f"), F.substring("label", 2, 30), F.lit("_0")).alias("label"))
    ends = p.where("opcode = 'LABEL'").select("program_id", (F.col("pc") * 2 + 1).alias("pc"), "opcode", F.concat(F.lit("end_f"), F.substring("label", 2, 30), F.lit("_1")).alias("label"))
    return cfg.subgraph_ranges(lab.union(ends)).select("program_id", "start_label", "end_label")


@query("rp09_longest_functions", derived.oracle("SELECT program_id, max_by(func, (n, func)) AS func, max(n) AS n FROM (SELECT o.program_id, o.func, CAST(sum(b.n_instr) AS BIGINT) AS n FROM own o JOIN blk b ON b.program_id = o.program_id AND b.label = o.label WHERE o.func IS NOT NULL GROUP BY o.program_id, o.func) GROUP BY program_id"))
def longest_functions(spark, sf):
    b = cfg.blocks(P._placed(spark, sf))
    own = cfg.owners(b, F.col("label").startswith("L")).where("func is not null").join(b.select("program_id", "label", "n_instr"), ["program_id", "label"])
    n = own.groupBy("program_id", "func").agg(F.sum("n_instr").alias("n"))
    w = Window.partitionBy("program_id").orderBy(F.desc("n"), F.desc("func"))
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("program_id", "func", "n")
