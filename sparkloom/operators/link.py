"""Linking modules of a project into one program by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import registry


def module_prefix(path: Column) -> Column:
    return F.replace(F.regexp_replace(F.ltrim(path, F.lit("/")), r"\.[A-Za-z0-9]+$", ""), F.lit("/"), F.lit("."))


def namespaced(prefix: Column, label: Column) -> Column:
    return F.concat(prefix, F.lit("."), label)


def rebased(reg: Column, base: Column) -> Column:
    """``%12`` after ``base`` registers of earlier modules."""
    return F.when(reg.rlike("^%[0-9]+$"), F.concat(F.lit("%"), (F.substring(reg, 2, 30).try_cast("bigint") + base).cast("string"))).otherwise(reg)


def offsets(modules: DataFrame, project: str, order: str, size: str) -> DataFrame:
    """``modules`` with base: the sizes of all earlier modules of the project."""
    w = Window.partitionBy(project).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return modules.withColumn("base", F.coalesce(F.sum(size).over(w), F.lit(0)))


def link(instr: DataFrame, order: DataFrame) -> DataFrame:
    """(project, linked_pc, program_id, opcode, label): modules in ``order`` (project, program_id, place) put one after the other, labels under their module's name, entry labels dropped."""
    own = instr.where("not (opcode = 'LABEL' and label = 'entry')")
    sizes = own.groupBy("program_id").agg(F.count(F.lit(1)).alias("size")).join(order, "program_id")
    base = offsets(sizes, "project", "place", "size").select("program_id", "project", "base")
    placed = own.withColumn("at", F.row_number().over(Window.partitionBy("program_id").orderBy("pc")) - 1).join(base, "program_id")
    label = F.when(F.col("label") != "", namespaced(F.concat(F.lit("m"), F.col("program_id").cast("string")), F.col("label"))).otherwise("")
    return placed.select("project", (F.col("at") + F.col("base")).alias("linked_pc"), "program_id", "opcode", label.alias("label"))


REGISTER = r"^(\*?)%([0-9]+)$"


def exports(code: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, module, name, label): functions (label under the module's name) and variables stored at top level (label null)."""
    m = modules.select("program_id", "project", F.col("prefix").alias("module"))
    funcs = registry.functions(code).where("class is null").select("program_id", "name", "label")
    over = Window.partitionBy("program_id").orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("opcode") == "LABEL", F.when(F.col("label").rlike(registry.FUNC), 1).when(F.col("label").rlike(r"^end_"), 0))
    top = code.withColumn("inside", F.last(mark, ignorenulls=True).over(over)).where("opcode in ('DECL_VAR', 'STORE_VAR') and coalesce(inside, 0) = 0")
    variables = top.select("program_id", F.get("operands", F.lit(0)).alias("name"), F.lit(None).cast("string").alias("label")).distinct()
    every = funcs.union(variables.join(funcs.select("program_id", "name"), ["program_id", "name"], "left_anti"))
    return every.join(m, "program_id").select("project", "module", "name", namespaced(F.col("module"), F.col("label")).alias("label"))


def resolved_imports(code: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, program_id, result_reg, module, name, resolved): each import, and whether a module of the project exports the name."""
    stub = code.where("opcode = 'IMPORT_MODULE'").join(modules.select("program_id", "project"), "program_id")
    path = F.get("operands", F.lit(0))
    stub = stub.select("project", "program_id", "result_reg", F.regexp_replace(F.substring_index(path, ":", 1), r"^\.+", "").alias("module"), F.when(F.contains(path, F.lit(":")), F.substring_index(path, ":", -1)).alias("name"))
    known = exports(code, modules).select("project", "module", "name").distinct().withColumn("resolved", F.lit(True))
    return stub.join(known, ["project", "module", "name"], "left").select("project", "program_id", "result_reg", "module", "name", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def module_bases(code: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, program_id, prefix, base, registers, start): highest register and one of all earlier modules, and their instructions without entry labels."""
    number = F.regexp_extract(F.coalesce("result_reg", F.lit("")), REGISTER, 2)
    own = code.groupBy("program_id").agg(F.coalesce(F.max(F.when(number != "", number.cast("bigint"))) + 1, F.lit(0)).alias("registers"), F.count(F.when(~((F.col("opcode") == "LABEL") & (F.col("label") == "entry")), 1)).alias("size"))
    each = modules.join(own, "program_id")
    each = offsets(each, "project", "place", "registers")
    w = Window.partitionBy("project").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("project", "program_id", "prefix", "base", "registers", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start"))


def link_modules(code: DataFrame, modules: DataFrame) -> DataFrame:
    """The instruction table of each project as one program (program_id is the project), ready to run.

    code: instruction table with literals as JSON (``lower_code``); modules (project, program_id, place, prefix), dependencies
    at lower places. Labels, targets and the functions that literals name go under the module's name, registers behind
    those of earlier modules; imports that the project resolves load the name that the other module stored; one entry label stands first.
    """
    i = code.where("not (opcode = 'LABEL' and label = 'entry')").join(module_bases(code, modules).drop("registers"), "program_id")
    names = resolved_imports(code, modules).where("resolved").select("program_id", "result_reg", F.col("name").alias("imported"))
    i = i.join(names, ["program_id", "result_reg"], "left")
    i = i.withColumn("at", F.row_number().over(Window.partitionBy("program_id").orderBy("pc")) + F.col("start"))
    under = lambda x: F.when(x != "", namespaced(F.col("prefix"), x)).otherwise(x)
    moved = lambda x: F.when(x.rlike(REGISTER), F.concat(F.regexp_extract(x, REGISTER, 1), F.lit("%"), (F.regexp_extract(x, REGISTER, 2).cast("bigint") + F.col("base")).cast("string"))).otherwise(x)
    literal = F.get("operands", F.lit(0))
    at_prefix = F.concat(F.lit("$1"), F.col("prefix"), F.lit("."))
    literal = F.when(literal.startswith('{"func"'), F.regexp_replace(literal, F.lit(r'^(\{"func": ")'), at_prefix)).when(literal.startswith('{"class"'), F.regexp_replace(literal, F.lit(r'(\["[^"]+", ")'), at_prefix)).otherwise(literal)
    operands = F.when(F.col("imported").isNotNull(), F.array("imported")).when(F.col("opcode") == "CONST", F.array(literal)).otherwise(F.transform("operands", moved))
    linked = i.select(
        F.col("project").alias("program_id"), F.col("at").cast("int").alias("pc"), F.when(F.col("imported").isNotNull(), "LOAD_VAR").otherwise(F.col("opcode")).alias("opcode"), moved(F.col("result_reg")).alias("result_reg"),
        operands.alias("operands"), under(F.col("label")).alias("label"), F.transform("branch_targets", under).alias("branch_targets"),
    )
    none = F.array().cast("array<string>")
    entry = modules.select("project").distinct().select(F.col("project").alias("program_id"), F.lit(0).alias("pc"), F.lit("LABEL").alias("opcode"), F.lit("").alias("result_reg"), none.alias("operands"), F.lit("entry").alias("label"), none.alias("branch_targets"))
    return entry.union(linked)
