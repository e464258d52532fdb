"""Type inference to a fixpoint, one task a program."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans import fixpoint

#: Types that built-in functions and methods give.
RETURNS = {"len": "Int", "int": "Int", "float": "Float", "str": "String", "bool": "Bool", "abs": "Number", "range": "Array[Int]", "sum": "Number", "round": "Int", "ord": "Int", "chr": "String", "sorted": "Array", ".upper": "String", ".lower": "String", ".strip": "String", ".split": "Array[String]", ".join": "String", ".replace": "String", ".startswith": "Bool", ".endswith": "Bool", ".keys": "Array", ".values": "Array"}


def literal(x: str) -> str:
    if x in ("True", "False", "true", "false"):
        return "Bool"
    if x in ("None", "null"):
        return "Null"
    body = x.lstrip("+-")
    if body.isdigit():
        return "Int"
    return "Float" if body.replace(".", "", 1).isdigit() else "String"


def binop(op: str, a: str, b: str) -> str:
    if op in ("==", "!=", "<", ">", "<=", ">=", "in", "not in", "is", "is not"):
        return "Bool"
    number = {"Int", "Float", "Bool"}
    if a in number and b in number:
        return "Float" if "Float" in (a, b) else "Int"
    return "String" if op == "+" and "String" in (a, b) else "Unknown"


def solve(rows: list[tuple], seeds: dict[str, str]) -> dict[str, str]:
    """Types of registers and variables of (opcode, result_reg, operands) rows; a known type is never lost."""
    known = dict(seeds)
    get = lambda x: known.get(x, "Unknown")
    size = -1
    while size != len(known):
        size = len(known)
        for op, reg, ops in rows:
            found, to = "Unknown", reg
            if op == "CONST":
                found = literal(ops[0])
            elif op == "LOAD_VAR":
                found = get(ops[0])
            elif op in ("STORE_VAR", "DECL_VAR"):
                to, found = ops[0], get(ops[1]) if len(ops) > 1 else "Unknown"
            elif op == "BINOP" and len(ops) == 3:
                a, b = get(ops[1]), get(ops[2])
                found = binop(ops[0], a, b) if "Unknown" not in (a, b) or ops[0] in ("==", "!=", "<", ">") else "Unknown"
            elif op == "UNOP":
                found = "Bool" if ops[0] in ("not", "!") else "Int" if ops[0] in ("#", "~") else get(ops[1])
            elif op in ("NEW_OBJECT", "CALL_CTOR"):
                found = ops[0]
            elif op == "NEW_ARRAY":
                found = "Array"
            elif op == "CALL_FUNCTION":
                found = RETURNS.get(ops[0], "Unknown")
            elif op == "CALL_METHOD":
                found = RETURNS.get("." + ops[1], "Unknown")
            elif op == "ALLOC_REGION":
                found = "Region"
            elif op == "LOAD_REGION":
                found = "Array[Int]"
            elif op == "ADDRESS_OF":
                found = f"Pointer[{get(ops[0])}]"
            if to and found != "Unknown" and to not in known:
                known[to] = found
    return known


def infer(instr: DataFrame, seeds: dict[str, str]) -> DataFrame:
    """(program_id, name, type) of every register and variable with a known type."""

    def types(rows):
        return solve([(o, r or "", p) for _, o, r, p in sorted(rows, key=lambda r: r[0])], seeds).items()

    return fixpoint.per_key(instr.select("program_id", "pc", "opcode", "result_reg", "operands"), "program_id", types, "program_id bigint, name string, type string")


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(name, target): what each alias (name, target) stands for at last, by pointer jumping; one on a cycle, or that leads to one, stands for itself."""
    now = fixpoint.settled(aliases.select("name", "target"))
    names = now.select(F.col("name").alias("target")).distinct()
    for _ in range(now.count().bit_length() + 1):
        if now.join(names, "target", "left_semi").isEmpty():
            return now
        on = now.select(F.col("name").alias("target"), F.col("target").alias("next"))
        now = fixpoint.settled(now.join(on, "target", "left").select("name", F.coalesce("next", "target").alias("target")))
    cyclic = names.withColumn("cyclic", F.lit(True))
    return now.join(cyclic, "target", "left").select("name", F.when(F.col("cyclic"), F.col("name")).otherwise(F.col("target")).alias("target"))


def signatures(p: DataFrame, types: DataFrame) -> DataFrame:
    """(program_id, func, signature) of placed programs: parameters in order and the result, with the types (program_id, name, type) that are known, else Any.

    The result has a type where all its returned registers of known type agree; the null that every body ends with counts only by itself.
    """
    from sparkloom.operators import registry, summaries

    body = summaries.bodies(p)
    params = summaries.parameters(body).join(types.select("program_id", F.col("name").alias("param"), "type"), ["program_id", "param"], "left")
    given = params.groupBy("program_id", "func").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(": ", "param", F.coalesce("type", F.lit("Any"))).alias("text")))).alias("p"))
    back = summaries.accesses(body).where("opcode = 'RETURN'").select("program_id", "func", F.col("value").alias("name")).join(types, ["program_id", "name"])
    result = back.groupBy("program_id", "func").agg(F.min("type").alias("one"), F.min(F.when(F.col("type") != "Null", F.col("type"))).alias("low"), F.max(F.when(F.col("type") != "Null", F.col("type"))).alias("high"))
    result = result.select("program_id", "func", F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNull(), F.col("one")).alias("result"))
    every = registry.functions(p).select("program_id", F.col("label").alias("func"), "name").join(given, ["program_id", "func"], "left").join(result, ["program_id", "func"], "left")
    listed = F.array_join(F.transform(F.coalesce("p", F.array().cast("array<struct<pos:int,text:string>>")), lambda x: x["text"]), ", ")
    return every.select("program_id", "func", F.concat("name", F.lit("("), listed, F.lit(") -> "), F.coalesce("result", F.lit("Any"))).alias("signature"))
