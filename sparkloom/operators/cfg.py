"""Control-flow graphs by windows over the instruction table.

All functions take any table of the instruction model and keep ``program_id`` in every key; the window
functions share one sort by (program, pc).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans.schema import ENDS_BLOCK, NO_FALL


def by_pc():
    return Window.partitionBy("program_id").orderBy("pc")


def placed(instr: DataFrame) -> DataFrame:
    """``instr`` with leader, block_ord, block (its name) and idx (place in the block; null for a block's LABEL).

    A leader is the first instruction, every LABEL and the one after a transfer of control; a block has its
    LABEL's name, or ``__block_`` and its first pc.
    """
    leader = (F.col("pc") == F.min("pc").over(Window.partitionBy("program_id"))) | (F.col("opcode") == "LABEL") | F.coalesce(F.lag("opcode").over(by_pc()).isin(*ENDS_BLOCK), F.lit(False))
    p = instr.withColumn("leader", leader)
    p = p.withColumn("block_ord", (F.sum(F.col("leader").cast("int")).over(by_pc().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    w = Window.partitionBy("program_id", "block_ord").orderBy("pc")
    name = F.when(F.col("opcode") == "LABEL", F.col("label")).otherwise(F.concat(F.lit("__block_"), F.col("pc").cast("string")))
    p = p.withColumn("block", F.first(name).over(w))
    label = (F.col("opcode") == "LABEL").cast("int")
    return p.withColumn("idx", F.when(F.col("opcode") != "LABEL", F.row_number().over(w) - 1 - F.max(label).over(w)).cast("int"))


def blocks(p: DataFrame) -> DataFrame:
    """(program_id, block_ord, label, first_pc, n_instr, last_op, targets): of blocks with one name the last stays, in the first's place."""
    b = p.groupBy("program_id", "block_ord").agg(
        F.first("block").alias("label"), F.min("pc").alias("first_pc"), F.count(F.when(F.col("opcode") != "LABEL", 1)).cast("int").alias("n_instr"),
        F.max_by("opcode", "pc").alias("last_op"), F.max_by("branch_targets", "pc").alias("targets"),
    )
    w = Window.partitionBy("program_id", "label").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = b.withColumn("place", F.first("block_ord").over(w)).withColumn("latest", F.last("block_ord").over(w)).where("block_ord = latest")
    return b.select("program_id", F.col("place").alias("block_ord"), "label", "first_pc", "n_instr", "last_op", "targets")


def edges(b: DataFrame) -> DataFrame:
    """(program_id, src, dst, ord): targets in order, or the fall-through to the next block; targets that are no block are dropped."""
    following = F.lead("label").over(Window.partitionBy("program_id").orderBy("block_ord"))
    out = F.when(F.col("last_op").isin("BRANCH", "BRANCH_IF"), F.col("targets")).when(F.col("last_op").isin(*NO_FALL), F.array().cast("array<string>")).otherwise(F.filter(F.array(following), lambda x: x.isNotNull()))
    e = b.withColumn("out", out).select("program_id", F.col("label").alias("src"), F.posexplode("out").alias("ord", "dst"))
    e = e.groupBy("program_id", "src", "dst").agg(F.min("ord").alias("ord"))
    names = b.select(F.col("program_id").alias("bp"), F.col("label").alias("bl"))
    return e.join(names, (e.program_id == F.col("bp")) & (e.dst == F.col("bl")), "left_semi")


def writes(p: DataFrame) -> DataFrame:
    """(program_id, block, idx, var): the storage each instruction writes."""
    var = F.when(F.col("opcode").isin("DECL_VAR", "STORE_VAR"), F.get("operands", F.lit(0))).otherwise(F.col("result_reg"))
    return p.where("idx is not null").select("program_id", "block", "idx", var.alias("var")).where("var is not null and var <> ''")


def reads(p: DataFrame) -> DataFrame:
    """(program_id, block, idx, var): the storage each instruction reads; a spread argument without its star."""
    ops = F.when(F.col("opcode") == "LOAD_VAR", F.slice("operands", 1, 1)).otherwise(F.transform(F.filter("operands", lambda x: x.rlike("^\\*?%")), lambda x: F.ltrim(x, F.lit("*"))))
    return p.where("idx is not null").select("program_id", "block", "idx", F.explode(ops).alias("var"))


def owners(b: DataFrame, is_function) -> DataFrame:
    """(program_id, label, block_ord, func): the last function entry at or before each block, code after its end included."""
    w = Window.partitionBy("program_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("program_id", "label", "block_ord", F.last(F.when(is_function, F.col("label")), ignorenulls=True).over(w).alias("func"))


def subgraph_ranges(p: DataFrame) -> DataFrame:
    """(program_id, start_label, end_label, start_pc, end_pc): each ``func_``/``class_`` label with the first later ``end_`` label of its name."""
    lab = p.where("opcode = 'LABEL'").select("program_id", "pc", "label")
    opens = lab.withColumn("name", F.regexp_extract("label", r"^(?:func|class)_(.+?)(?:_\d+)?$", 1)).where("label rlike '^(func|class)_'")
    ends = lab.withColumn("name", F.regexp_extract("label", r"^end_(?:func_|class_)?(.+?)(?:_\d+)?$", 1)).where("label rlike '^end_'").select(F.col("program_id").alias("ep"), F.col("pc").alias("epc"), F.col("label").alias("elabel"), F.col("name").alias("ename"))
    j = opens.join(ends, (opens.program_id == F.col("ep")) & (opens.name == F.col("ename")) & (F.col("epc") > F.col("pc")))
    return j.groupBy("program_id", F.col("label").alias("start_label"), F.col("pc").alias("start_pc")).agg(F.min_by("elabel", "epc").alias("end_label"), F.min("epc").alias("end_pc"))


def text(p: DataFrame) -> DataFrame:
    """(program_id, pc, line): each instruction as text."""
    body = F.concat_ws(" ", F.lower("opcode"), F.array_join("operands", " "), F.array_join("branch_targets", ", "))
    body = F.regexp_replace(F.trim(body), " +", " ")
    return p.select("program_id", "pc", F.when(F.col("opcode") == "LABEL", F.concat("label", F.lit(":"))).when(F.coalesce("result_reg", F.lit("")) != "", F.concat("result_reg", F.lit(" = "), body)).otherwise(body).alias("line"))


def mermaid_nodes(p: DataFrame, b: DataFrame, most: int = 6, keep: int = 4) -> DataFrame:
    """(program_id, label, shape, lines): stadium for entry and returning blocks, rhombus for branching ones; long bodies fold."""
    lines = text(p.where("idx is not null")).join(p.select("program_id", "pc", "block"), ["program_id", "pc"])
    body = lines.groupBy("program_id", F.col("block").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "line"))), lambda x: x["line"]).alias("lines"))
    n = F.size("lines")
    folded = F.when(n > most, F.concat(F.slice("lines", 1, keep), F.array(F.concat(F.lit("... ("), (n - keep - 1).cast("string"), F.lit(" more)"))), F.slice("lines", n, F.lit(1)))).otherwise(F.col("lines"))
    shape = F.when((F.col("block_ord") == 0) | F.col("last_op").isin("RETURN", "THROW"), "stadium").when(F.col("last_op") == "BRANCH_IF", "rhombus").otherwise("box")
    out = b.join(body, ["program_id", "label"], "left")
    return out.select("program_id", "label", shape.alias("shape"), F.array_join(F.coalesce(folded, F.array().cast("array<string>")), "\n").alias("lines"))
