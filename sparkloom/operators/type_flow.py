"""Types of registers, variables and array elements as a fixpoint over a lattice.

A type is a set of leaf types, kept as a bit mask, and the least upper bound of types is the union of their
sets; a set is named by the narrowest type of the lattice that holds it (Int and Float: Number, Int and String: Any).
Each instruction passes types on: copies (loads, stores, signs) as they are, operators by the pairs of leaf types that
their operands can have, arrays to their elements, named ``array[]``. A copied array shares its elements both ways.

Programs of up to ``fixpoint.GROUP_ROWS`` instructions are solved in one task each; larger ones by semi-naive rounds over one
table: the types that grew in the last round are joined to the copies and operators that use them, what
arrives at a name is united by one aggregate, and the round is written to the shared folder. Types only grow, so both ways end, and
they end equal. Rows with null or missing operands pass nothing on; names without a type have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.inference import RETURNS
from sparkloom.plans import fixpoint
from sparkloom.plans.schema import TYPES

ROUNDS = 100_000
COMPARISONS = ("==", "!=", "<", ">", "<=", ">=", "in", "not in", "is", "is not")


def _masks() -> dict[str, int]:
    """Each lattice type's set of leaves: a bit of its own (a plain Number or Object is one of its own, too) and those of the types below it."""
    own = {name: 1 << k for k, (name, _) in enumerate(t for t in TYPES if t[0] not in ("Any", "Number"))}
    below = {name: own.get(name, 0) for name, _ in TYPES}
    for _ in TYPES:
        for name, parent in TYPES:
            if parent:
                below[parent] |= below[name]
    return below


MASKS = _masks()
INT, FLOAT, STRING, BOOL = (MASKS[t] for t in ("Int", "Float", "String", "Bool"))
WHOLE, NUMERIC = INT | BOOL, INT | BOOL | FLOAT


def mask_of(name: str) -> int:
    """The mask of a type text; parameters (``Array[Int]``) are left off, unknown names are classes."""
    return MASKS.get(name.split("[")[0], MASKS["Object"])


def type_name(mask: Column) -> Column:
    """The narrowest lattice type that holds the set."""
    out = None
    for name, m in sorted(MASKS.items(), key=lambda x: (x[1].bit_count(), x[1])):
        fits = mask.bitwiseAND(F.lit(((1 << 62) - 1) & ~m)) == 0
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def binop_mask(op: str, a: int, b: int) -> int:
    """The set that the operator gives for operands of the sets ``a`` and ``b``; nothing while either is unknown, but for comparisons."""
    if op in COMPARISONS:
        return BOOL
    if not a or not b:
        return 0
    out = (INT if a & WHOLE and b & WHOLE else 0) | (FLOAT if a & FLOAT and b & NUMERIC or b & FLOAT and a & NUMERIC else 0)
    if op == "+":
        out |= STRING if (a | b) & STRING else 0
    return out


def _binop_column(op: Column, a: Column, b: Column) -> Column:
    """:func:`binop_mask` for columns; ``a`` and ``b`` are null while unknown."""
    has = lambda x, bits: x.bitwiseAND(F.lit(bits)) != 0
    bit = lambda cond, bits: F.when(cond, F.lit(bits)).otherwise(F.lit(0)).cast("long")
    out = bit(has(a, WHOLE) & has(b, WHOLE), INT).bitwiseOR(bit((has(a, FLOAT) & has(b, NUMERIC)) | (has(b, FLOAT) & has(a, NUMERIC)), FLOAT))
    out = out.bitwiseOR(bit((op == "+") & (has(a, STRING) | has(b, STRING)), STRING))
    return F.when(op.isin(*COMPARISONS), F.lit(BOOL).cast("long")).when(a.isNull() | b.isNull(), F.lit(0).cast("long")).otherwise(out)


def _literal_mask(x: Column) -> Column:
    body = F.regexp_replace(x, r"^[+-]+", "")
    return (
        F.when(x.isin("True", "False", "true", "false"), BOOL).when(x.isin("None", "null"), 0).when(body.rlike(r"^[0-9]+$"), INT)
        .when(body.rlike(r"^([0-9]+\.[0-9]*|\.[0-9]+)$"), FLOAT).otherwise(STRING).cast("long")
    )


def constraints(instr: DataFrame, seeds: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, copies, binops) of instructions: (program_id, name, mask), (program_id, src, dst), (program_id, op, a, b, name)."""
    at = lambda k: F.get("operands", F.lit(k))
    op, reg = F.col("opcode"), F.col("result_reg")
    element = lambda c: F.concat(c, F.lit("[]"))
    edge = lambda s, d: F.struct(s.alias("src"), d.alias("dst"))
    nothing = F.array().cast("array<struct<src:string,dst:string>>")
    shared = lambda s, d: F.array(edge(s, d), edge(element(s), element(d)), edge(element(d), element(s)))
    flows = (
        F.when(op == "LOAD_VAR", shared(at(0), reg)).when(op.isin("STORE_VAR", "DECL_VAR"), shared(at(1), at(0)))
        .when((op == "UNOP") & at(0).isin("-", "+"), F.array(edge(at(1), reg))).when(op == "STORE_INDEX", F.array(edge(at(2), element(at(0))))).when(op == "LOAD_INDEX", F.array(edge(element(at(0)), reg)))
        .otherwise(nothing)
    )
    copies = instr.select("program_id", F.inline(flows)).where("src is not null and dst is not null").distinct()
    call = F.when(op == "CALL_FUNCTION", at(0)).when(op == "CALL_METHOD", F.concat(F.lit("."), at(1)))
    returns = F.create_map(*[x for k, v in RETURNS.items() for x in (F.lit(k), F.lit(mask_of(v)).cast("long"))])
    constant = {"NEW_OBJECT": "Object", "CALL_CTOR": "Object", "NEW_ARRAY": "Array", "ALLOC_REGION": "Region", "LOAD_REGION": "Array", "ADDRESS_OF": "Pointer"}
    given = F.when(op == "CONST", _literal_mask(at(0))).when(call.isNotNull(), F.try_element_at(returns, call)).when((op == "UNOP") & at(0).isin("not", "!"), BOOL).when((op == "UNOP") & at(0).isin("#", "~"), INT)
    for name, kind in constant.items():
        given = given.when(op == name, MASKS[kind])
    facts = instr.select("program_id", reg.alias("name"), given.cast("long").alias("mask"))
    stored = instr.where(op == "STORE_INDEX").select("program_id", at(0).alias("name"), F.lit(MASKS["Array"]).cast("long").alias("mask"))
    names = instr.select("program_id", F.explode(F.array(F.when(op.isin("LOAD_VAR", "STORE_VAR", "DECL_VAR", "STORE_INDEX", "LOAD_INDEX"), at(0)))).alias("name")).where("name is not null").distinct()
    seeded = F.create_map(*[x for k, v in seeds.items() for x in (F.lit(k), F.lit(mask_of(v)).cast("long"))]) if seeds else F.create_map().cast("map<string,bigint>")
    facts = facts.union(stored).union(names.withColumn("mask", F.try_element_at(seeded, F.col("name")))).where("name is not null and mask <> 0")
    binops = instr.where((op == "BINOP") & reg.isNotNull() & (F.size("operands") == 3)).select("program_id", at(0).alias("op"), at(1).alias("a"), at(2).alias("b"), reg.alias("name")).distinct()
    return facts.groupBy("program_id", "name").agg(F.bit_or("mask").alias("mask")), copies, binops


def _rounds(facts: DataFrame, copies: DataFrame, binops: DataFrame) -> DataFrame:
    key = ["program_id", "name"]
    copies, binops = fixpoint.settled(copies), fixpoint.settled(binops)
    compared = binops.where(F.col("op").isin(*COMPARISONS)).select("program_id", "name", F.lit(BOOL).cast("long").alias("mask"))
    now = new = fixpoint.settled(facts.union(compared).groupBy(key).agg(F.bit_or("mask").alias("mask")))
    users = fixpoint.settled(binops.select("*", F.explode(F.array_distinct(F.array("a", "b"))).alias("uses")).where("uses is not null"))
    for _ in range(ROUNDS):
        copied = new.join(copies.withColumnRenamed("src", "name"), key).select("program_id", F.col("dst").alias("name"), "mask")
        touched = users.join(new.select("program_id", F.col("name").alias("uses")), ["program_id", "uses"]).select("program_id", "op", "a", "b", "name").distinct()
        of = lambda side: now.select("program_id", F.col("name").alias(side), F.col("mask").alias(f"m{side}"))  # noqa: E731, B023
        made = touched.join(of("a"), ["program_id", "a"], "left").join(of("b"), ["program_id", "b"], "left")
        made = made.select("program_id", "name", _binop_column(F.col("op"), F.col("ma"), F.col("mb")).alias("mask"))
        arrived = copied.union(made).groupBy(key).agg(F.bit_or("mask").alias("more")).where("more <> 0")
        both = now.join(arrived, key, "full").select(*key, F.coalesce("mask", F.lit(0).cast("long")).alias("old"), F.coalesce("more", F.lit(0).cast("long")).alias("more"))
        both = fixpoint.settled(both.select(*key, F.col("old").bitwiseOR(F.col("more")).alias("mask"), (F.col("more").bitwiseAND(F.bitwise_not("old")) != 0).alias("grew")))
        now, new = both.select(*key, "mask"), both.where("grew").select(*key, "mask")
        if new.isEmpty():
            return now
    raise RuntimeError("the types did not settle")


def _solve(rows: list[tuple]):
    """The same for one program's constraints: (kind, x, y, op, mask) with facts (name, mask), copies (src, dst), operators (a, b, name in ``op``'s place, operator)."""
    types: dict[str, int] = {}
    flows: dict[str, list] = {}
    todo = []

    def grow(name: str, mask: int) -> None:
        if mask & ~types.get(name, 0):
            types[name] = types.get(name, 0) | mask
            todo.append(name)

    facts = []
    for kind, x, y, z, op, mask in rows:
        if kind == "fact":
            facts.append((x, mask))
        elif kind == "copy":
            flows.setdefault(x, []).append((None, None, None, y))
        else:
            for side in {x, y} - {None}:
                flows.setdefault(side, []).append((op, x, y, z))
            if op in COMPARISONS:
                facts.append((z, BOOL))
    for name, mask in facts:
        grow(name, mask)
    while todo:
        name = todo.pop()
        for op, a, b, to in flows.get(name, ()):
            grow(to, types[name] if op is None else binop_mask(op, types.get(a, 0), types.get(b, 0)))
    return types.items()


def infer(instr: DataFrame, seeds: dict[str, str]) -> DataFrame:
    """(program_id, name, type, element) of every register and variable with a type; ``element`` is that of an array's elements, null if none is known."""
    small, big, _ = fixpoint.split(instr.select("program_id", "pc", "opcode", "result_reg", "operands"), "program_id")
    facts, copies, binops = constraints(small, seeds)
    text, number = F.lit(None).cast("string"), F.lit(0).cast("long")
    rows = facts.select("program_id", F.lit("fact").alias("kind"), F.col("name").alias("x"), text.alias("y"), text.alias("z"), text.alias("op"), "mask")
    rows = rows.union(copies.select("program_id", F.lit("copy"), "src", "dst", text, text, number)).union(binops.select("program_id", F.lit("binop"), "a", "b", "name", "op", number))
    kind = instr.schema["program_id"].dataType.simpleString()
    masks = fixpoint.per_key(rows, "program_id", _solve, f"program_id {kind}, name string, mask bigint")
    if big is not None:
        masks = masks.unionByName(_rounds(*constraints(big, seeds)))
    masks = fixpoint.settled(masks)
    named = masks.where(~F.col("name").endswith("[]")).select("program_id", "name", type_name(F.col("mask")).alias("type"))
    elements = masks.where(F.col("name").endswith("[]")).select("program_id", F.expr("substring(name, 1, length(name) - 2)").alias("name"), type_name(F.col("mask")).alias("element"))
    return named.join(elements, ["program_id", "name"], "left").select("program_id", "name", "type", "element")
