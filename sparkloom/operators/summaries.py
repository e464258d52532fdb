"""Function summaries: what flows from a function's parameters to its result, to fields and through pointers, and what that means at call sites.

Every relation has a row for each fact and (program_id, func) in its key. A flow goes from an endpoint
(kind, base, field) to another: a variable, a field of a variable, what a pointer variable points to, or the function's
result. Endpoints are written ``v``, ``v.f``, ``*v`` and ``return f``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import cfg, dataflow, interproc, registry
from sparkloom.plans import fixpoint

END = r"^(?:.*\.)?end_"
KEY = ["program_id", "func"]
FLOW = [*KEY, "src_kind", "src", "src_field", "dst_kind", "dst", "dst_field", "block", "idx"]


def bodies(p: DataFrame) -> DataFrame:
    """Instructions of placed programs with ``func``: the function from whose label on, up to an end label, they lie."""
    label = F.col("opcode") == "LABEL"
    mark = F.when(label & F.col("label").rlike(registry.FUNC), F.col("label")).when(label & F.col("label").rlike(END), "")
    over = Window.partitionBy("program_id").orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("func", F.last(mark, ignorenulls=True).over(over)).where("func <> ''")


def parameters(body: DataFrame) -> DataFrame:
    """(program_id, func, pos, param): variables stored from the register of a ``param:`` symbol, in its order."""
    s = body.where("opcode = 'SYMBOLIC' and operands[0] like 'param:%'").select(*KEY, F.col("result_reg").alias("reg"), F.col("pc").alias("at"))
    st = body.where("opcode in ('DECL_VAR', 'STORE_VAR')").select(*KEY, F.expr("operands[1]").alias("reg"), F.expr("operands[0]").alias("param"))
    got = s.join(st, [*KEY, "reg"]).groupBy(*KEY, "param").agg(F.min("at").alias("at"))
    return got.select(*KEY, (F.row_number().over(Window.partitionBy(*KEY).orderBy("at")) - 1).alias("pos"), "param")


def accesses(body: DataFrame) -> DataFrame:
    """(program_id, func, block, idx, opcode, result, base, field, value): returns, field and pointer reads and writes as register facts."""
    op = lambda n: F.get("operands", F.lit(n))
    kind = F.col("opcode")
    some = body.where(kind.isin("RETURN", "STORE_FIELD", "LOAD_FIELD", "STORE_INDIRECT", "LOAD_INDIRECT"))
    value = F.when(kind == "RETURN", op(0)).when(kind == "STORE_FIELD", op(2)).when(kind == "STORE_INDIRECT", op(1))
    field = F.when(kind.isin("STORE_FIELD", "LOAD_FIELD"), op(1))
    return some.select(*KEY, "block", "idx", "opcode", F.col("result_reg").alias("result"), F.when(kind != "RETURN", op(0)).alias("base"), field.alias("field"), value.alias("value"))


def loaded(body: DataFrame) -> DataFrame:
    """(program_id, func, reg, var): the variable that a register was first loaded from."""
    x = body.where("opcode = 'LOAD_VAR'")
    return x.groupBy(*KEY, F.col("result_reg").alias("reg")).agg(F.min_by(F.expr("operands[0]"), "pc").alias("var"))


def _within(body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, dependencies): registers' variables (reg, var) and variables' closed dependencies (var, needs), function by function."""
    key = F.concat_ws("\0", F.col("program_id").cast("string"), "func")
    each = body.withColumn("program_id", key)
    names = cfg.writes(each), cfg.reads(each)
    sources = fixpoint.checkpointed(dataflow.named_sources(dataflow.produced_from(*names)))
    needs = fixpoint.closure_by_key(dataflow.raw_dependencies(each, sources), "program_id")
    part = F.split("program_id", "\0")
    apart = [part[0].cast("bigint").alias("program_id"), part[1].alias("func")]
    return sources.select(*apart, "reg", "var"), needs.select(*apart, F.col("src").alias("var"), F.col("dst").alias("needs"))


def summary(p: DataFrame) -> DataFrame:
    """Flows (:data:`FLOW`) of every function: parameter to result, to field, through pointers."""
    body = fixpoint.checkpointed(bodies(p).select(*KEY, "pc", "block", "idx", "opcode", "result_reg", "operands"))
    sources, needs = _within(body)
    params = fixpoint.checkpointed(parameters(body).select(*KEY, "param"))
    var = fixpoint.checkpointed(loaded(body))
    acc = fixpoint.checkpointed(accesses(body))
    none = F.lit(None).cast("string")
    var_of = lambda reg, out: var.select(*KEY, F.col("reg").alias(reg), F.col("var").alias(out))
    is_param = lambda name: params.select(*KEY, F.col("param").alias(name))
    # the parameters that a variable's value comes from: itself, else those it depends on
    deeper = needs.join(params, (needs.program_id == params.program_id) & (needs.func == params.func) & (needs.needs == params.param)).select(needs.program_id, needs.func, "var", "param")
    deeper = deeper.join(params.select(*KEY, F.col("param").alias("var")), [*KEY, "var"], "left_anti")
    origin = fixpoint.checkpointed(params.select(*KEY, F.col("param").alias("var"), "param").union(deeper).distinct())

    def flow(rows, src_kind, src, src_field, dst_kind, dst, dst_field):
        return rows.select(*KEY, F.lit(src_kind).alias("src_kind"), src.alias("src"), src_field.alias("src_field"), F.lit(dst_kind).alias("dst_kind"), dst.alias("dst"), dst_field.alias("dst_field"), "block", "idx")

    ret = acc.where("opcode = 'RETURN'").select(*KEY, "block", "idx", F.col("value").alias("reg"))
    pointers = acc.where("opcode = 'LOAD_INDIRECT'").select(*KEY, F.col("result").alias("reg"), F.col("base").alias("ptr")).join(var_of("ptr", "base"), [*KEY, "ptr"]).join(is_param("base"), [*KEY, "base"])
    through = ret.join(pointers, [*KEY, "reg"])
    rest = ret.join(pointers, [*KEY, "reg"], "left_anti").join(var_of("reg", "var"), [*KEY, "reg"], "left")
    named = rest.where("var is not null").join(origin, [*KEY, "var"])
    computed = rest.where("var is null").drop("var").join(sources, [*KEY, "reg"]).join(is_param("var"), [*KEY, "var"])
    stores = body.where("opcode in ('DECL_VAR', 'STORE_VAR')").select(*KEY, F.expr("operands[0]").alias("var"), F.expr("operands[1]").alias("result"))
    fields = acc.where("opcode = 'LOAD_FIELD'").select(*KEY, "result", F.col("base").alias("reg"), "field").join(var_of("reg", "base"), [*KEY, "reg"]).join(is_param("base"), [*KEY, "base"]).drop("reg")
    read = rest.where("var is not null").join(is_param("var"), [*KEY, "var"], "left_anti").join(stores.join(fields, [*KEY, "result"]).select(*KEY, "var", "base", "field"), [*KEY, "var"])
    written = acc.where("opcode in ('STORE_FIELD', 'STORE_INDIRECT')").withColumnRenamed("base", "reg").join(var_of("reg", "base"), [*KEY, "reg"]).join(is_param("base"), [*KEY, "base"]).drop("reg")
    valued = written.withColumnRenamed("value", "reg").join(var_of("reg", "var"), [*KEY, "reg"]).join(origin, [*KEY, "var"])
    f, c = F.col("func"), F.col
    every = [
        flow(through, "dereference", c("base"), none, "return", f, none),
        flow(named, "variable", c("param"), none, "return", f, none),
        flow(computed, "variable", c("var"), none, "return", f, none),
        flow(read, "field", c("base"), c("field"), "return", f, none),
        flow(valued.where("opcode = 'STORE_FIELD'"), "variable", c("param"), none, "field", c("base"), c("field")),
        flow(written.where("opcode = 'STORE_INDIRECT'"), "variable", c("base"), none, "dereference", c("base"), none),
        flow(valued.where("opcode = 'STORE_INDIRECT' and param <> base"), "variable", c("param"), none, "dereference", c("base"), none),
    ]
    out = every[0]
    for x in every[1:]:
        out = out.union(x)
    return out.distinct()


def sites(p: DataFrame) -> DataFrame:
    """(program_id, caller, block, idx, result, args, func): calls inside functions with each function they may enter; a method's receiver is its first argument."""
    f, calls = registry.functions(p), registry.call_sites(p).where("caller is not null")
    plain = interproc.resolve_functions(calls.where("kind in ('CALL_FUNCTION', 'CALL_CTOR')"), f.where("class is null")).where("callee is not null")
    methods = f.where("class is not null").select("program_id", F.col("name").alias("target"), F.col("label").alias("callee"))
    by_name = calls.where("kind = 'CALL_METHOD'").withColumn("args", F.concat(F.array("receiver"), "args")).join(methods, ["program_id", "target"])
    keep = ["program_id", "caller", "block", "idx", "result", "args", F.col("callee").alias("func")]
    return plain.select(*keep).union(by_name.select(*keep))


def contexts(p: DataFrame, flows: DataFrame) -> DataFrame:
    """(program_id, func, caller, block, idx, flows): each function's number of flows in each context, the call that enters it; null (the root) without calls.

    No flow depends on its context, as a summary never reads another's: one pass is the fixpoint.
    """
    every = registry.functions(p).select("program_id", F.col("label").alias("func"))
    n = flows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("flows"))
    at = sites(p).select(*KEY, "caller", "block", "idx")
    return every.join(at, KEY, "left").join(n, KEY, "left").na.fill(0, ["flows"])


def substituted(p: DataFrame, flows: DataFrame) -> DataFrame:
    """(program_id, caller, func, block, idx, src, dst): every flow at every call, with the caller's variables for parameters and result.

    A register stands for the variable it was loaded from in the call's block, else the one it is stored to there, else
    the one whose address it is; else it keeps its name. A pointer's target is the variable pointed to.
    """
    facts = p.where("opcode in ('LOAD_VAR', 'DECL_VAR', 'STORE_VAR', 'ADDRESS_OF')")
    rank = F.when(F.col("opcode") == "LOAD_VAR", 0).when(F.col("opcode") == "ADDRESS_OF", 2).otherwise(1)
    reg = F.when(F.col("opcode").isin("LOAD_VAR", "ADDRESS_OF"), F.col("result_reg")).otherwise(F.expr("operands[1]"))
    trace = facts.groupBy("program_id", "block", reg.alias("reg")).agg(F.min_by(F.expr("operands[0]"), F.struct(rank, "pc")).alias("var"))
    at = sites(p)
    body = bodies(p)
    formal = parameters(body)
    actual = at.select("program_id", "caller", "func", "block", "idx", F.posexplode("args").alias("pos", "reg")).join(formal, [*KEY, "pos"])
    actual = actual.join(trace, ["program_id", "block", "reg"], "left").select("program_id", "caller", "func", "block", "idx", "param", F.coalesce("var", "reg").alias("name"))
    result = at.select("program_id", "caller", "func", "block", "idx", F.col("result").alias("reg")).join(trace, ["program_id", "block", "reg"], "left")
    result = result.select("program_id", "caller", "func", "block", "idx", F.coalesce("var", "reg").alias("to"))
    rows = flows.select(*KEY, "src_kind", "src", "src_field", "dst_kind", "dst", "dst_field").join(result, KEY)
    where = ["program_id", "caller", "func", "block", "idx"]
    for end in ("src", "dst"):
        rows = rows.join(actual.withColumnRenamed("param", end).withColumnRenamed("name", f"{end}_name"), [*where, end], "left")
    name = lambda end: F.when(F.col(f"{end}_kind") == "return", F.col("to")).otherwise(F.concat_ws(".", F.coalesce(f"{end}_name", end), f"{end}_field"))
    return rows.select(*where, name("src").alias("src"), name("dst").alias("dst")).distinct()


def endpoint(end: str):
    """The endpoint of a flow as text."""
    kind = F.col(f"{end}_kind")
    return F.when(kind == "return", F.concat(F.lit("return "), end)).when(kind == "dereference", F.concat(F.lit("*"), end)).otherwise(F.concat_ws(".", end, f"{end}_field"))


def whole_program(p: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, closed): (program_id, src, dst) of all summaries and their substitutions, and its transitive closure."""
    raw = flows.select("program_id", endpoint("src").alias("src"), endpoint("dst").alias("dst"))
    raw = fixpoint.checkpointed(raw.union(substituted(p, flows).select("program_id", "src", "dst")).distinct())
    return raw, fixpoint.closure_by_key(raw, "program_id")


def report(p: DataFrame, flows: DataFrame) -> DataFrame:
    """(program_id, func, callers, callees, param_to_return, param_to_field, other) of every function."""
    calls = registry.call_graph(p)
    kind = F.when((F.col("src_kind") == "variable") & (F.col("dst_kind") == "return"), "param_to_return").when((F.col("src_kind") == "variable") & (F.col("dst_kind") == "field"), "param_to_field").otherwise("other")
    typed = flows.withColumn("kind", kind).groupBy(*KEY).pivot("kind", ["param_to_return", "param_to_field", "other"]).count()
    out = registry.functions(p).select("program_id", F.col("label").alias("func"))
    out = out.join(calls.groupBy("program_id", F.col("dst").alias("func")).agg(F.count(F.lit(1)).alias("callers")), KEY, "left")
    out = out.join(calls.groupBy("program_id", F.col("src").alias("func")).agg(F.count(F.lit(1)).alias("callees")), KEY, "left")
    return out.join(typed, KEY, "left").na.fill(0)


def analyze(p: DataFrame) -> dict[str, DataFrame]:
    """Call graph, summaries with their contexts, and the whole program's flows, raw and closed, of placed programs."""
    p = fixpoint.checkpointed(p)
    flows = fixpoint.checkpointed(summary(p))
    raw, closed = whole_program(p, flows)
    return {"calls": registry.call_graph(p), "summary": flows, "contexts": contexts(p, flows), "raw": raw, "closed": closed, "report": report(p, flows)}


def function_cfg(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, edges) of each function: (program_id, func, block) reached from its entry inside its body, and (program_id, func, src, dst) among them."""
    own = bodies(p).select(*KEY, "block").distinct()
    e = cfg.edges(cfg.blocks(p)).select("program_id", "src", "dst")
    inner = e.join(own.withColumnRenamed("block", "src"), ["program_id", "src"]).join(own.withColumnRenamed("block", "dst"), [*KEY, "dst"])
    key = F.concat_ws("\0", F.col("program_id").cast("string"), "func")
    seen = fixpoint.reach_by_key(inner.select(key.alias("k"), "src", "dst"), own.where("block = func").select(key.alias("k"), F.col("block").alias("node")), "k")
    part = F.split("k", "\0")
    blocks = fixpoint.checkpointed(seen.select(part[0].cast("bigint").alias("program_id"), part[1].alias("func"), F.col("node").alias("block")))
    edges = inner.join(blocks.withColumnRenamed("block", "src"), [*KEY, "src"]).join(blocks.withColumnRenamed("block", "dst"), [*KEY, "dst"])
    return blocks, edges.select(*KEY, "src", "dst")
