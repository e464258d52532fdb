"""Interprocedural analysis: call graph, parameter flows, substitution at call sites, taint and slices."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.fixpoint import apart, per_key


def resolve_functions(sites: DataFrame, funcs: DataFrame) -> DataFrame:
    """``sites`` (…, target) with callee: a label of ``funcs`` (program_id, label, name, ord), else the last one of that name; null if none."""
    by_label = funcs.select(F.col("program_id").alias("lp"), F.col("label").alias("ll")).distinct()
    by_name = funcs.groupBy("program_id", "name").agg(F.max_by("label", "ord").alias("nl")).withColumnRenamed("program_id", "np").withColumnRenamed("name", "nn")
    s = sites.join(by_label, (sites.program_id == F.col("lp")) & (sites.target == F.col("ll")), "left")
    s = s.join(by_name, (s.program_id == F.col("np")) & (s.target == F.col("nn")), "left")
    return s.withColumn("callee", F.coalesce("ll", "nl")).drop("lp", "ll", "np", "nn", "nl")


def resolve_methods(sites: DataFrame, methods: DataFrame) -> DataFrame:
    """Class-hierarchy resolution: every (class, func) of ``methods`` (program_id, class, method, func) with the method's name, whatever the receiver."""
    return sites.join(methods, ["program_id", "method"], "left")


def call_edges(sites: DataFrame) -> DataFrame:
    """(program_id, src, dst): caller and callee of sites inside functions."""
    return sites.where("caller is not null and callee is not null").select("program_id", F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def param_returns(dep: DataFrame, params: DataFrame, returns: DataFrame) -> DataFrame:
    """(program_id, func, param): parameters that a returned variable depends on. dep (program_id, src, dst) is closed; a returned parameter flows directly."""
    direct = params.join(returns.select("program_id", "func", F.col("var").alias("param")), ["program_id", "func", "param"])
    through = params.join(returns, ["program_id", "func"]).join(dep.select("program_id", F.col("src").alias("var"), F.col("dst").alias("param")), ["program_id", "var", "param"])
    return direct.select("program_id", "func", "param").union(through.select("program_id", "func", "param")).distinct()


def substitute(summary: DataFrame, params: DataFrame, sites: DataFrame) -> DataFrame:
    """(program_id, src, dst): each summary flow param -> return at each call site, actual for formal and result for return; surplus arguments are ignored.

    params (program_id, func, pos, param); sites (program_id, callee, args array, result).
    """
    formal = summary.join(params, ["program_id", "func", "param"]).select("program_id", F.col("func").alias("callee"), "pos")
    actual = sites.select("program_id", "callee", "result", F.posexplode("args").alias("pos", "arg"))
    return actual.join(formal, ["program_id", "callee", "pos"]).select("program_id", F.col("arg").alias("src"), F.col("result").alias("dst")).distinct()


def impact_of(closure: DataFrame, start) -> DataFrame:
    """What a node reaches (itself only on a cycle)."""
    return closure.where(F.col("src") == start).select("program_id", F.col("dst").alias("node"))


def backward_slice(closure: DataFrame, target) -> DataFrame:
    """What reaches a node, without the node itself."""
    return closure.where((F.col("dst") == target) & (F.col("src") != target)).select("program_id", F.col("src").alias("node"))


def taint_pairs(closure: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(program_id, source, sink) of all pairs joined by the closure."""
    t = closure.join(sources.select("program_id", F.col("node").alias("src")), ["program_id", "src"], "left_semi")
    return t.join(sinks.select("program_id", F.col("node").alias("dst")), ["program_id", "dst"], "left_semi").select("program_id", F.col("src").alias("source"), F.col("dst").alias("sink"))


def call_trees(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(program_id, root, path, depth, recursive): all call paths from the roots, of any length; a function met again on its path ends it as a recursive leaf.

    Each root is a row of its own and its paths leave the task in batches, so that their number does not bear on memory.
    """

    def solve(frames):
        import pandas as pd

        def paths(src, dst, root):
            adj: dict = {}
            for s, d in zip(src, dst):
                adj.setdefault(s, set()).add(d)
            todo = [([root], False)]
            while todo:
                path, again = todo.pop()
                yield " > ".join(path), len(path) - 1, again
                if not again:
                    todo += [([*path, d], d in path) for d in sorted(adj.get(path[-1], ()), reverse=True)]

        for pdf in frames:
            for program, root, src, dst in zip(pdf["program_id"], pdf["root"], pdf["src"], pdf["dst"]):
                found = paths(() if src is None else src, () if dst is None else dst, root)
                while rows := list(islice(found, 10_000)):
                    out = pd.DataFrame(rows, columns=["path", "depth", "recursive"])
                    out.insert(0, "program_id", program)
                    out.insert(1, "root", root)
                    yield out

    of = edges.groupBy("program_id").agg(F.collect_list(F.struct("src", "dst")).alias("e")).select("program_id", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
    each = apart(roots, "program_id", "node").distinct().withColumnRenamed("node", "root").join(of, "program_id", "left")
    return each.select("program_id", "root", "src", "dst").mapInPandas(solve, "program_id bigint, root string, path string, depth int, recursive boolean")


def taint_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(program_id, source, sink, path): one shortest path over edges (program_id, src, dst) for each pair (program_id, source, sink), the least in order of its nodes.

    The source alone where both are equal, an empty path where there is none.
    """

    def solve(rows):
        adj: dict = {}
        for a, b, is_pair in rows:
            if not is_pair:
                adj.setdefault(a, set()).add(b)
        for source, sink, is_pair in rows:
            if is_pair:
                paths, front = {source: [source]}, [source]
                while front and sink not in paths:
                    ahead = []
                    for x in front:  # in the order of their paths
                        for d in sorted(adj.get(x, ())):
                            if d not in paths:
                                paths[d] = [*paths[x], d]
                                ahead.append(d)
                    front = ahead
                yield source, sink, paths.get(sink, [])

    kind = edges.schema["program_id"].dataType.simpleString()
    both = edges.select("program_id", "src", "dst", F.lit(False).alias("pair")).union(pairs.select("program_id", "source", "sink", F.lit(True)))
    return per_key(both, "program_id", solve, f"program_id {kind}, source string, sink string, path array<string>")
