"""Linking any number of modules of any number of projects, one of which may hold most of them.

A module's place in its project's program, and its registers' base, are sums over all earlier modules. They are taken in
ranges of (project, place): every range sums its own modules, and the totals of a project's earlier ranges, a row a
range and project, are added. No window holds a project, so one with most of the modules is spread over all ranges.

Symbols: a name means the module's own export if it has one, else that of the module at the lowest place in the project that exports
it, else it stays as it is. References are rewritten by a join of the distinct (module, name) pairs with the merged symbols.

Every module begins with a label of its own name, so that the one before it runs on into it. Labels and targets go under the module's name;
a target ``__block_n`` (a block without a label, by its place) moves with its place. Modules that are not listed are left out, listed ones without
instructions take no place; of modules with one place the lesser program comes first; null places come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.link import REGISTER
from sparkloom.plans.fixpoint import settled

NAMES = ("LOAD_VAR", "STORE_VAR", "DECL_VAR")


def running_totals(df: DataFrame, group: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each entry out: column of ``sums``, the column's sum over all rows of the group before this one in ``order``."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = settled(df.repartitionByRange(n, group, *order).withColumn("__range", F.spark_partition_id()))
    earlier = Window.partitionBy("__range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range", group).agg(*[F.sum(c).alias(f"__{out}") for out, c in sums.items()])
    ranges = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__range", group, *[F.coalesce(F.sum(f"__{out}").over(ranges), F.lit(0)).alias(f"__{out}") for out in sums])
    own = ranged.withColumns({out: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for out, c in sums.items()})
    out = own.join(before, ["__range", group])
    return out.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__range", *[f"__{k}" for k in sums])


def module_name(program: Column) -> Column:
    return F.concat(F.lit("m"), program.cast("string"))


def module_bases(code: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, program_id, place, start, base): instructions and registers (highest number and one) of all earlier modules."""
    number = F.regexp_extract(F.coalesce("result_reg", F.lit("")), REGISTER, 2)
    own = code.groupBy("program_id").agg((F.count(F.lit(1)) + 1).alias("size"), F.coalesce(F.max(F.when(number != "", number.cast("bigint"))) + 1, F.lit(0)).alias("registers"))
    each = modules.select("project", "program_id", "place").join(own, "program_id")
    return running_totals(each, "project", ["place", "program_id"], {"start": "size", "base": "registers"}).select("project", "program_id", "place", "start", "base")


def merged_symbols(exports: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, name, owner, exporters) of exports (program_id, name): the module whose symbol the name means, and how many export it."""
    e = exports.select("program_id", "name").distinct().join(modules.select("project", "program_id", "place"), "program_id")
    return e.groupBy("project", "name").agg(F.min(F.struct("place", "program_id")).alias("first"), F.count(F.lit(1)).alias("exporters")).select("project", "name", F.col("first.program_id").alias("owner"), "exporters")


def link_table(code: DataFrame, modules: DataFrame, exports: DataFrame) -> DataFrame:
    """(project, pc, program_id, opcode, result_reg, operands, label, branch_targets): each project as one program.

    code: instruction table; modules (project, program_id, place); exports (program_id, name), the variables that each module gives to others.
    """
    bases = settled(module_bases(code, modules))
    name = F.get("operands", F.lit(0))
    own = exports.select("program_id", "name").distinct().withColumn("own", F.lit(True))
    used = code.where(F.col("opcode").isin(*NAMES)).select("program_id", name.alias("name")).where("name is not null").distinct()
    used = used.join(bases.select("program_id", "project"), "program_id").join(own, ["program_id", "name"], "left")
    used = used.join(merged_symbols(exports, modules).drop("exporters"), ["project", "name"], "left")
    owner = F.when(F.col("own"), F.col("program_id")).otherwise(F.col("owner"))
    meant = used.where(owner.isNotNull()).select(F.col("program_id").alias("up"), F.col("name").alias("un"), F.concat(module_name(owner), F.lit("."), "name").alias("meant"))
    i = code.join(bases, "program_id").withColumn("at", F.row_number().over(Window.partitionBy("program_id").orderBy("pc")) + F.col("start"))
    # A name is looked up by instructions that have one; the others carry a key that no name has.
    i = i.withColumn("un", F.when(F.col("opcode").isin(*NAMES), name)).join(meant.withColumnRenamed("un", "mn"), (F.col("program_id") == F.col("up")) & (F.col("un") == F.col("mn")), "left")
    moved = lambda x: F.when(x.rlike(REGISTER), F.concat(F.regexp_extract(x, REGISTER, 1), F.lit("%"), (F.regexp_extract(x, REGISTER, 2).cast("bigint") + F.col("base")).cast("string"))).otherwise(x)
    prefix = module_name(F.col("program_id"))
    place = lambda x: F.regexp_extract(x, "^__block_([0-9]+)$", 1)
    target = lambda x: F.when(place(x) == "0", prefix).when(place(x) != "", F.concat(F.lit("__block_"), (place(x).cast("bigint") + F.col("start") + 1).cast("string"))).otherwise(F.concat(prefix, F.lit("."), x))
    operands = F.transform("operands", lambda x, k: F.when((k == 0) & F.col("meant").isNotNull(), F.col("meant")).otherwise(moved(x)))
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(prefix, F.lit("."), "label")).otherwise("")
    linked = i.select("project", F.col("at").cast("long").alias("pc"), "program_id", "opcode", moved(F.col("result_reg")).alias("result_reg"), operands.alias("operands"), label.alias("label"), F.transform("branch_targets", target).alias("branch_targets"))
    none = F.array().cast("array<string>")
    heads = bases.select("project", F.col("start").cast("long").alias("pc"), "program_id", F.lit("LABEL").alias("opcode"), F.lit(None).cast("string").alias("result_reg"), none.alias("operands"), module_name(F.col("program_id")).alias("label"), none.alias("branch_targets"))
    return heads.union(linked)
