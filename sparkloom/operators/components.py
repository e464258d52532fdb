"""Strongly connected components of one large graph, their condensation and its leaves-first order, by rounds of joins.

Nothing is held for a whole graph: nodes without edges in or out are trimmed, the rest is coloured by
the greatest node that reaches each node, and the nodes that reach back to their colour's own node within
the colour are its component. Components leave the graph, and what is left is trimmed and coloured again.
Edges that join two colours are on no cycle and go with the first colouring.

Every round is written to the shared folder; rounds are as many as the longest path that they follow, so
colours also take their colour's colour, which halves a path each time. A null end of an edge is no
node; repeated edges count once; an edge from a node to itself makes no larger component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.fixpoint import levels, settled

ROUNDS = 100_000


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those that lead to nodes with no way on, or come from nodes with no way in; repeated while a third goes each time."""
    n = edges.count()
    while n:
        ends = edges.select(F.col("src").alias("x")).distinct().intersect(edges.select(F.col("dst").alias("x")).distinct())
        ends = settled(ends)
        edges = settled(edges.join(ends.withColumnRenamed("x", "src"), "src", "left_semi").join(ends.withColumnRenamed("x", "dst"), "dst", "left_semi"))
        left = edges.count()
        if left > 0.7 * n:
            break
        n = left
    return edges


def colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that reaches each node of ``edges`` (src, dst), itself included."""
    now = settled(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
    new = now
    for _ in range(ROUNDS):
        hop = new.join(edges, new.node == edges.src).select(F.col("dst").alias("node"), "colour")
        jump = new.select("node", F.col("colour").alias("by")).join(now.select(F.col("node").alias("by"), "colour"), "by").select("node", "colour")
        better = hop.union(jump).groupBy("node").agg(F.max("colour").alias("found"))
        both = settled(now.join(better, "node", "left").select("node", F.greatest("colour", F.coalesce("found", "colour")).alias("colour"), (F.col("found") > F.col("colour")).alias("is_new")))
        now, new = both.select("node", "colour"), both.where("is_new").select("node", "colour")
        if new.isEmpty():
            return now
    raise RuntimeError("the colours did not settle")


def _reached_back(edges: DataFrame, coloured: DataFrame) -> DataFrame:
    """(node, colour) of the nodes that reach their colour's own node over ``edges`` inside the colour."""
    inside = edges.join(coloured.select(F.col("node").alias("src"), F.col("colour").alias("sc")), "src").join(coloured.select(F.col("node").alias("dst"), "colour"), "dst")
    back = settled(inside.where("sc = colour").select(F.col("src").alias("to"), F.col("dst").alias("node"), "colour"))
    seen = new = settled(coloured.where("node = colour"))
    for k in range(1, ROUNDS):
        hop = new.join(back, ["node", "colour"]).select(F.col("to").alias("node"), "colour").distinct()
        new = settled(hop.join(seen, ["node", "colour"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = settled(seen.union(new)) if k % 8 == 0 else seen.union(new)
    raise RuntimeError("the components did not settle")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for each of ``nodes`` (node) and each end of ``edges`` (src, dst): the least node of its strongly connected component."""
    edges = settled(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    every = settled(nodes.select("node").union(edges.select("src")).union(edges.select("dst")).where("node is not null").distinct())
    live, found = _trimmed(edges.where("src <> dst")), None
    while not live.isEmpty():
        coloured = colours(live)
        group = settled(_reached_back(live, coloured))
        found = group if found is None else found.union(group)
        of = coloured.join(group.select("node", F.lit(True).alias("done")), "node", "left").select("node", "colour", F.coalesce("done", F.lit(False)).alias("done"))
        ends = live.join(of.select(F.col("node").alias("src"), F.col("colour").alias("sc"), F.col("done").alias("sd")), "src").join(of.select(F.col("node").alias("dst"), F.col("colour").alias("dc"), F.col("done").alias("dd")), "dst")
        live = _trimmed(settled(ends.where("sc = dc and not sd and not dd").select("src", "dst")))
    if found is None:
        return every.select("node", F.col("node").alias("component"))
    least = found.groupBy("colour").agg(F.min("node").alias("component"))
    named = found.join(least, "colour").select("node", "component")
    return every.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, rank): ranks count from 0 for components that lead nowhere else; a component stands above all that it leads to."""
    of = settled(strong_components(nodes, edges))
    name = lambda end, as_: of.select(F.col("node").alias(end), F.col("component").alias(as_))
    between = edges.join(name("src", "a"), "src").join(name("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    ranks = levels(of.select(F.col("component").alias("node")), between).select(F.col("node").alias("component"), F.col("level").alias("rank"))
    return of.join(ranks, "component").select("node", "component", "rank")


def order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, cyclic, position): every node after all that it leads to (src needs dst); those on or above a circle last, marked, level null.

    Positions count from 0 over all nodes, by level and within one by node, the marked ones by node; they are ranks of sampled ranges.
    """
    from sparkloom.operators.linking import running_totals

    edges = settled(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    every = nodes.select("node").union(edges.select("src")).union(edges.select("dst")).where("node is not null").distinct()
    of = settled(strong_components(every, edges).join(edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop")), "node", "left"))
    circles = of.groupBy("component").agg((F.count(F.lit(1)) > 1).alias("many"), F.max("loop").alias("loop")).where("many or loop").select("component")
    bad = new = settled(of.join(circles, "component").select("node"))
    for _ in range(ROUNDS):
        if new.isEmpty():
            break
        above = edges.join(new.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        new = settled(above.join(bad, "node", "left_anti"))
        bad = settled(bad.union(new))
    good = of.join(bad, "node", "left_anti").select("node")
    sure = edges.join(bad.withColumnRenamed("node", "src"), "src", "left_anti")
    ranked = levels(good, sure).select("node", F.col("level").cast("int").alias("level"), F.lit(False).alias("cyclic")).union(bad.select("node", F.lit(None).cast("int"), F.lit(True)))
    ranked = ranked.withColumns({"all": F.lit(0), "one": F.lit(1)})
    return running_totals(ranked, "all", ["cyclic", "level", "node"], {"position": "one"}).select("node", "level", "cyclic", F.col("position").cast("long").alias("position"))
