"""The type system: lattice tables, typing rules as Columns, structural types in plain Python."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans import fixpoint
from sparkloom.plans.schema import TYPES

PARENT = {n: [p] if p else [] for n, p in TYPES}
VARIANTS = {"Array": "covariant", "Map": "covariant", "Tuple": "covariant", "Pointer": "covariant"}


def ancestors(types: DataFrame) -> DataFrame:
    """(name, ancestor, depth): every type with itself and all above it; a child may have several rows."""
    edges = types.where("parent <> ''").select(F.col("name").alias("src"), F.col("parent").alias("dst"))
    seeds = types.select(F.col("name").alias("root"), F.col("name").alias("node")).distinct()
    out = seeds.withColumn("depth", F.lit(0))
    new, depth = out, 0
    while True:
        depth += 1
        new = fixpoint.checkpointed(new.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().join(out.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return out.select(F.col("root").alias("name"), F.col("node").alias("ancestor"), "depth")
        out = out.union(new)


def least_upper_bounds(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lub) of pairs (a, b): a's nearest ancestor that is also b's; Any for unknown names."""
    up = closure.select(F.col("name").alias("a"), "ancestor", F.col("depth").alias("da"))
    other = closure.select(F.col("name").alias("b"), "ancestor")
    met = pairs.join(up, "a").join(other, ["b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", F.struct("da", "ancestor")).alias("lub"))
    out = pairs.join(met, ["a", "b"], "left")
    return out.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.coalesce("lub", F.lit("Any"))).alias("lub"))


def binop_type(op: Column, a: Column, b: Column) -> Column:
    """Static result type: comparisons give Bool, Int with Float Float, Bool counts as Int, Int / Int stays Int; else Unknown."""
    number = lambda x: x.isin("Int", "Float", "Bool")
    return (
        F.when(op.isin("==", "!=", "<", ">", "<=", ">=", "===", "~=", "in", "not in"), "Bool")
        .when(op.isin("+", "-", "*", "/", "//", "%", "**") & number(a) & number(b), F.when((a == "Float") | (b == "Float"), "Float").otherwise("Int"))
        .when((op == "+") & ((a == "String") | (b == "String")), "String").otherwise("Unknown")
    )


def unop_type(op: Column, a: Column) -> Column:
    return F.when(op.isin("not", "!"), "Bool").when(op.isin("#", "~"), "Int").otherwise(a)


def stringify(x: Column, kind: str) -> Column:
    return F.when(x, "true").otherwise("false") if kind == "Bool" else x.cast("string")


def assign(x: Column, have: str, want: str) -> Column:
    """Float to Int truncates toward zero, Int to Float and Bool to Int widen, all else stays."""
    to = {("Float", "Int"): "bigint", ("Int", "Float"): "double", ("Bool", "Int"): "bigint", ("Bool", "Float"): "double"}.get((have, want))
    return (x.cast("int").cast(to) if have == "Bool" else x.cast(to)) if to else x


def score(have: Column, want: Column, is_subtype: Column) -> Column:
    """Fit of an argument: 2 exact, 1 coercible or below, 0 unknown, -1 otherwise."""
    coercible = F.concat_ws(">", have, want).isin("Int>Float", "Float>Int", "Bool>Int", "Bool>Float")
    return F.when((have == "Unknown") | (want == "Unknown"), 0).when(have == want, 2).when(coercible | is_subtype, 1).otherwise(-1)


def rank_overloads(candidates: DataFrame, call: list[str]) -> DataFrame:
    """candidates (call…, ord, n_params, n_args, score) with rank (1 is chosen) and n_candidates: least arity distance, best score, first declared."""
    from pyspark.sql import Window

    w = Window.partitionBy(*call)
    order = w.orderBy(F.abs(F.col("n_params") - F.col("n_args")), F.desc("score"), "ord")
    return candidates.withColumn("rank", F.row_number().over(order)).withColumn("n_candidates", F.count(F.lit(1)).over(w))


def choose(ranked: DataFrame, strict: bool = False) -> DataFrame:
    """The first candidate of each call, with ``ambiguous``: whether others were ranked too; ``strict`` makes that an error."""
    several = F.col("n_candidates") >= 2
    flag = F.when(several, F.raise_error(F.lit("a call has several candidates"))).otherwise(several) if strict else several
    return ranked.where("rank = 1").withColumn("ambiguous", flag)


# structural types: Name, Name[A, B], Union[A, B], Optional[A], Fn(A, B) -> R
@lru_cache(maxsize=4096)
def parse(text: str):
    """A type as (constructor, arguments); unions are flat, without repeats and sorted; functions are ('Fn', (params…, result))."""
    tokens = re.findall(r"[A-Za-z_]\w*|->|[\[\](),]", text)
    at = 0

    def one():
        nonlocal at
        name = tokens[at]
        at += 1
        if name == "Fn":
            at += 1
            args = []
            while tokens[at] != ")":
                args.append(one())
                at += tokens[at] == ","
            at += 2
            return ("Fn", (*args, one()))
        if at < len(tokens) and tokens[at] == "[":
            at += 1
            args = []
            while tokens[at] != "]":
                args.append(one())
                at += tokens[at] == ","
            at += 1
            if name == "Optional":
                return union([*args, ("Null", ())])
            return union(args) if name == "Union" else (name, tuple(args))
        return (name, ())

    return one()


def union(members):
    flat = {x for m in members for x in (m[1] if m[0] == "Union" else (m,))}
    return next(iter(flat)) if len(flat) == 1 else ("Union", tuple(sorted(flat)))


def show(t) -> str:
    if t[0] == "Fn":
        return f"Fn({', '.join(map(show, t[1][:-1]))}) -> {show(t[1][-1])}"
    return t[0] + (f"[{', '.join(map(show, t[1]))}]" if t[1] else "")


def _above(name: str) -> list[str]:
    out, todo = [], [name]
    while todo:
        n = todo.pop(0)
        if n not in out:
            out.append(n)
            todo += PARENT.get(n, [])
    return out


def is_subtype(a, b) -> bool:
    if a == b:
        return True
    if a[0] == "Union":
        return all(is_subtype(x, b) for x in a[1])
    if b[0] == "Union":
        return any(is_subtype(a, x) for x in b[1])
    if a[0] == b[0] == "Fn":
        return len(a[1]) == len(b[1]) and all(is_subtype(y, x) for x, y in zip(a[1][:-1], b[1][:-1])) and is_subtype(a[1][-1], b[1][-1])
    if a[1] and b[1]:
        return a[0] == b[0] and len(a[1]) == len(b[1]) and all(is_subtype(x, y) for x, y in zip(a[1], b[1]))
    if b[1]:
        return False
    return a[0] in PARENT and b[0] in PARENT and b[0] in _above(a[0])


def lub(a, b):
    if is_subtype(a, b):
        return b
    if is_subtype(b, a):
        return a
    if "Union" in (a[0], b[0]):
        return union([a, b])
    if a[0] == b[0] and len(a[1]) == len(b[1]) and a[1]:
        return (a[0], tuple(lub(x, y) for x, y in zip(a[1], b[1])))
    high = set(_above(b[0]))
    return (next((x for x in _above(a[0]) if x in high and a[0] in PARENT), "Any"), ())


def _compare(a: str, b: str):
    x, y = parse(a), parse(b)
    return is_subtype(x, y), show(lub(x, y))


def compare(a: str, b: str) -> Column:
    """Struct (below, lub) of two columns of types in text."""

    def work(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_compare(x, y) for x, y in zip(a, b)], columns=["below", "lub"])

    return F.pandas_udf(work, T.StructType([T.StructField("below", T.BooleanType()), T.StructField("lub", T.StringType())]))(a, b)
