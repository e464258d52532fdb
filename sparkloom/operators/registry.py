"""Functions, parameters, classes and call sites of lowered programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import cfg, interproc

FUNC = r"^(?:.*\.)?func_(.+)_\d+$"
CLASS = r"^(?:.*\.)?class_(.+)_\d+$"


def functions(p: DataFrame) -> DataFrame:
    """(program_id, label, name, ord, class): function labels in order; the class whose body holds them, else null."""
    lab = p.where("opcode = 'LABEL'").select("program_id", "pc", "label")
    w = Window.partitionBy("program_id").orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("label").rlike(CLASS) & ~F.col("label").contains("end_class_"), F.regexp_extract("label", CLASS, 1)).when(F.col("label").contains("end_class_"), "")
    lab = lab.withColumn("class", F.last(mark, ignorenulls=True).over(w))
    f = lab.where(F.col("label").rlike(FUNC))
    return f.select("program_id", "label", F.regexp_extract("label", FUNC, 1).alias("name"), F.col("pc").alias("ord"), F.when(F.col("class") != "", F.col("class")).alias("class"))


def label_kinds(p: DataFrame) -> DataFrame:
    """(program_id, label, kind, name, namespace): entry, function, class, end (of a function), end_class, or block."""
    form = r"^(?:(.*)\.)?(func|class|end_class|end)_(.+)_\d+$"
    lab = p.where("opcode = 'LABEL'").select("program_id", "label")
    found = F.regexp_extract("label", form, 2)
    bare = F.regexp_extract("label", r"([^.]*)$", 1)
    kind = F.when(bare == "entry", "entry").when(found == "func", "function").when(found == "", "block").otherwise(found)
    return lab.select("program_id", "label", kind.alias("kind"), F.when(found != "", F.regexp_extract("label", form, 3)).alias("name"), F.regexp_extract("label", r"^(.*)\.[^.]*$", 1).alias("namespace"))


def parameters(p: DataFrame) -> DataFrame:
    """(program_id, func, pos, param): ``param:`` symbols of the blocks a function owns, in order."""
    b = cfg.blocks(p)
    own = cfg.owners(b, F.col("label").rlike(FUNC)).where("func is not null").select("program_id", F.col("label").alias("block"), "func")
    s = p.where("opcode = 'SYMBOLIC'").withColumn("hint", F.get("operands", F.lit(0))).where("hint like 'param:%'").join(own, ["program_id", "block"])
    w = Window.partitionBy("program_id", "func").orderBy("pc")
    return s.select("program_id", "func", (F.row_number().over(w) - 1).alias("pos"), F.substring("hint", F.lit(7), F.length("hint")).alias("param"))


def call_sites(p: DataFrame) -> DataFrame:
    """(program_id, caller, block, idx, kind, target, args, result, receiver): calls with the function that owns their block (null at top level)."""
    own = cfg.owners(cfg.blocks(p), F.col("label").rlike(FUNC)).select("program_id", F.col("label").alias("block"), F.col("func").alias("caller"))
    c = p.where("opcode in ('CALL_FUNCTION', 'CALL_CTOR', 'CALL_METHOD', 'CALL_UNKNOWN')").join(own, ["program_id", "block"])
    method = F.col("opcode") == "CALL_METHOD"
    target = F.when(method, F.get("operands", F.lit(1))).when(F.col("opcode") == "CALL_UNKNOWN", F.lit(None).cast("string")).otherwise(F.get("operands", F.lit(0)))
    args = F.when(method, F.slice("operands", F.lit(3), F.size("operands"))).otherwise(F.slice("operands", F.lit(2), F.size("operands")))
    return c.select("program_id", "caller", "block", "idx", F.col("opcode").alias("kind"), target.alias("target"), args.alias("args"), F.col("result_reg").alias("result"), F.when(method, F.get("operands", F.lit(0))).alias("receiver"))


def call_graph(p: DataFrame) -> DataFrame:
    """(program_id, src, dst): plain calls by label or name, method calls to every class that defines the name."""
    f, sites = functions(p), call_sites(p)
    plain = interproc.resolve_functions(sites.where("kind in ('CALL_FUNCTION', 'CALL_CTOR')"), f.where("class is null"))
    methods = f.where("class is not null").select("program_id", F.col("name").alias("target"), F.col("label").alias("callee"))
    by_name = sites.where("kind = 'CALL_METHOD'").join(methods, ["program_id", "target"])
    made = f.where("class is not null and name = '__init__'").select("program_id", F.col("class").alias("target"), F.col("label").alias("callee"))
    built = sites.where("kind = 'CALL_FUNCTION'").join(made, ["program_id", "target"])
    keep = ["program_id", "caller", "callee"]
    return interproc.call_edges(plain.select(*keep).union(by_name.select(*keep)).union(built.select(*keep)))
