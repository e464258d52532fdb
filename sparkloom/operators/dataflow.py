"""Dataflow analysis: definitions, reaching definitions, chains and dependencies.

Everything that stays inside a program is either a window or one job by program; the reaching-definitions
solver works on bit sets and always runs to the true fixpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans import fixpoint


def _kind(df: DataFrame) -> str:
    return df.schema["program_id"].dataType.simpleString()


def gen(defs: DataFrame) -> DataFrame:
    """(program_id, block, var, idx): the last definition of each variable in each block."""
    return defs.groupBy("program_id", "block", "var").agg(F.max("idx").alias("idx"))


def kill(g: DataFrame) -> DataFrame:
    """(program_id, block, var, def_block, def_idx): other blocks' definitions of what a block redefines."""
    other = g.select("program_id", "var", F.col("block").alias("def_block"), F.col("idx").alias("def_idx"))
    return g.select("program_id", "block", "var").join(other, ["program_id", "var"]).where("block <> def_block")


def reaching(g: DataFrame, edges: DataFrame) -> DataFrame:
    """(program_id, block, var, def_block, def_idx): definitions that reach a block's beginning.

    in = union of the predecessors' out; out = gen + (in - kill). One task a program; a definition is a bit, so a visit of a
    block costs a few machine words a predecessor. Programs of over ``fixpoint.GROUP_ROWS`` rows go by rounds of joins.
    """

    def solve(rows):
        facts = [r for r in rows if r[2] is not None]
        succ: dict = {}
        for s, d, idx in rows:
            if idx is None:
                succ.setdefault(s, []).append(d)
        of_var: dict = {}
        for i, (_, v, _) in enumerate(facts):
            of_var[v] = of_var.get(v, 0) | 1 << i
        gens: dict = {}
        keep: dict = {}
        for i, (b, v, _) in enumerate(facts):
            gens[b] = gens.get(b, 0) | 1 << i
            keep[b] = keep.get(b, 0) | of_var[v]
        into: dict = {}
        todo = list(gens)
        queued = set(todo)
        while todo:
            b = todo.pop()
            queued.discard(b)
            out = gens.get(b, 0) | into.get(b, 0) & ~keep.get(b, 0)
            for d in succ.get(b, ()):
                if out & ~into.get(d, 0):
                    into[d] = into.get(d, 0) | out
                    if d not in queued:
                        queued.add(d)
                        todo.append(d)
        for b, bits in into.items():
            while bits:
                i = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                yield b, facts[i][1], facts[i][0], facts[i][2]

    # Facts are (block, var, idx) and edges (src, dst, null), so that both lie side by side.
    both = g.select("program_id", F.col("block").alias("a"), F.col("var").alias("b"), "idx").union(edges.select("program_id", "src", "dst", F.lit(None).cast("int")))
    small, big, _ = fixpoint.split(both, "program_id")
    out = fixpoint.per_key(small, "program_id", solve, f"program_id {_kind(g)}, block string, var string, def_block string, def_idx int")
    if big is None:
        return out
    facts = big.where("idx is not null").select("program_id", F.col("a").alias("block"), F.col("b").alias("var"), "idx")
    return out.union(reaching_rounds(facts, big.where("idx is null").select("program_id", F.col("a").alias("src"), F.col("b").alias("dst"))))


def reaching_rounds(g: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by semi-naive rounds of joins, for programs of any size."""
    edges = fixpoint.checkpointed(edges.select("program_id", F.col("src").alias("block"), "dst").distinct())
    g = fixpoint.checkpointed(g.select("program_id", "block", "var", "idx"))
    fact = ["program_id", "block", "var", "def_block", "def_idx"]
    out = g.select("program_id", "block", "var", F.col("block").alias("def_block"), F.col("idx").alias("def_idx"))
    seen = None
    while True:
        hop = out.join(edges, ["program_id", "block"]).select("program_id", F.col("dst").alias("block"), "var", "def_block", "def_idx").distinct()
        new = fixpoint.checkpointed(hop if seen is None else hop.join(seen, fact, "left_anti"))
        if new.isEmpty():
            return new if seen is None else seen
        seen = new if seen is None else fixpoint.checkpointed(seen.union(new))
        out = new.join(g, ["program_id", "block", "var"], "left_anti")


def def_use(defs: DataFrame, uses: DataFrame, reach: DataFrame) -> DataFrame:
    """(program_id, var, def_block, def_idx, use_block, use_idx): the nearest earlier definition of the block, else all that reach it."""
    d = defs.select("program_id", "block", "var", F.lit(1).alias("side"), "idx")
    u = uses.distinct().select("program_id", "block", "var", F.lit(0).alias("side"), "idx")
    w = Window.partitionBy("program_id", "block", "var").orderBy("idx", "side").rowsBetween(Window.unboundedPreceding, -1)
    near = d.union(u).withColumn("def_idx", F.last(F.when(F.col("side") == 1, F.col("idx")), ignorenulls=True).over(w)).where("side = 0")
    local = near.where("def_idx is not null").select("program_id", "var", F.col("block").alias("def_block"), "def_idx", F.col("block").alias("use_block"), F.col("idx").alias("use_idx"))
    far = near.where("def_idx is null").select("program_id", "block", "var", F.col("idx").alias("use_idx")).join(reach, ["program_id", "block", "var"])
    return local.union(far.select("program_id", "var", "def_block", "def_idx", F.col("block").alias("use_block"), "use_idx"))


def produced_from(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(program_id, var, source): storage and the storage that its defining instructions read."""
    u = uses.select("program_id", "block", "idx", F.col("var").alias("source"))
    return defs.join(u, ["program_id", "block", "idx"]).select("program_id", "var", "source").distinct()


def named_sources(flow: DataFrame) -> DataFrame:
    """(program_id, reg, var): each register with the variables found by walking registers back; programs of over ``fixpoint.GROUP_ROWS`` rows by rounds."""

    def solve(rows):
        up: dict = {}
        for v, s in rows:
            up.setdefault(v, set()).add(s)
        for r in up:
            if r.startswith("%"):
                seen, todo, out = set(), [r], set()
                while todo:
                    for s in up.get(todo.pop(), ()):
                        if not s.startswith("%"):
                            out.add(s)
                        elif s not in seen:
                            seen.add(s)
                            todo.append(s)
                yield from ((r, v) for v in out)

    small, big, _ = fixpoint.split(flow.select("program_id", "var", "source"), "program_id")
    out = fixpoint.per_key(small, "program_id", solve, f"program_id {_kind(flow)}, reg string, var string")
    if big is None:
        return out
    walk = fixpoint.closure(big.where("var like '\\%%'").select("program_id", F.col("var").alias("src"), F.col("source").alias("dst")), ["program_id"])
    return out.union(walk.where("dst not like '\\%%'").select("program_id", F.col("src").alias("reg"), F.col("dst").alias("var")))


def raw_dependencies(p: DataFrame, sources: DataFrame) -> DataFrame:
    """(program_id, src, dst): a stored variable (src) and each variable (dst) its value is computed from."""
    stores = p.where("opcode in ('DECL_VAR', 'STORE_VAR')").select("program_id", F.get("operands", F.lit(0)).alias("src"), F.get("operands", F.lit(1)).alias("reg"))
    direct = stores.where("reg not like '\\%%'").select("program_id", "src", F.col("reg").alias("dst"))
    through = stores.join(sources, ["program_id", "reg"]).select("program_id", "src", F.col("var").alias("dst"))
    return direct.union(through).distinct()
