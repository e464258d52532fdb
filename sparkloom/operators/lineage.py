"""Ancestors in trees of any depth by jump tables: the 1st, 2nd, 4th, ... ancestor of every node, never the closure.

A table of n nodes and depth d has n * log2(d) rows. A question about two nodes is answered in log2(d) rounds of
joins, all questions at once. Nodes without a parent are roots; a parent that is no node of the table is a root of its own.
A chain of parents that runs into a circle raises an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.fixpoint import settled


class JumpTable:
    """``steps[k]`` holds (node, up): the 2^k-th ancestor of every node that has one; ``depth`` (node, depth), roots 0."""

    def __init__(self, parents: DataFrame, node: str = "node", parent: str = "parent"):
        p = parents.select(F.col(node).alias("node"), F.col(parent).alias("up")).where("node is not null").distinct()
        step = settled(p.where("up is not null"))
        self.steps, most = [], step.count()
        # The part of a node's depth that its jumps so far have covered: a node with no more jumps has all of it.
        depth = p.select("node").union(p.where("up is not null").select("up")).distinct().withColumns({"at": F.col("node"), "depth": F.lit(0).cast("long")})
        while not step.isEmpty():
            if 1 << len(self.steps) > most:
                raise ValueError("the parents run in a circle")
            self.steps.append(step)
            step = settled(step.join(step.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up")))
        depth = settled(depth)
        for k in reversed(range(len(self.steps))):
            up = self.steps[k].select(F.col("node").alias("at"), "up")
            depth = settled(depth.join(up, "at", "left").select("node", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth")))
        self.depth = depth.select("node", "depth")

    def raised(self, pairs: DataFrame, node: str, by: str) -> DataFrame:
        """``pairs`` with ``node`` replaced by its ancestor ``by`` levels up; ``by`` must not pass the root."""
        for k, step in enumerate(self.steps):
            up = step.select(F.col("node").alias("__n"), F.col("up").alias("__up"))
            far = F.col(by).bitwiseAND(F.lit(1 << k)) != 0
            pairs = settled(pairs.join(up, (F.col(node) == F.col("__n")) & far, "left").withColumn(node, F.coalesce("__up", node)).drop("__n", "__up"))
        return pairs

    def bounds(self, pairs: DataFrame) -> DataFrame:
        """(a, b, is_below, bound) of distinct ``pairs`` (a, b): whether b is a or an ancestor of a, and their lowest common ancestor (null: none)."""
        d = self.depth
        q = pairs.select("a", "b").distinct()
        q = q.join(d.select(F.col("node").alias("a"), F.col("depth").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("depth").alias("db")), "b")
        q = q.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), F.greatest(F.col("da") - F.col("db"), F.lit(0)).alias("up_x"), F.greatest(F.col("db") - F.col("da"), F.lit(0)).alias("up_y"))
        q = self.raised(self.raised(q, "x", "up_x"), "y", "up_y")
        below = (F.col("x") == F.col("b")) & (F.col("up_y") == 0)
        q = settled(q.select("a", "b", "x", "y", below.alias("is_below")))
        for step in reversed(self.steps):
            ux, uy = (step.select(F.col("node").alias(c), F.col("up").alias(f"u{c}")) for c in "xy")
            q = q.join(ux, "x", "left").join(uy, "y", "left")
            apart = F.coalesce((F.col("ux") != F.col("uy")) & (F.col("x") != F.col("y")), F.lit(False))
            q = settled(q.select("a", "b", "is_below", F.when(apart, F.col("ux")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("uy")).otherwise(F.col("y")).alias("y")))
        if not self.steps:
            return q.select("a", "b", "is_below", F.when(F.col("x") == F.col("y"), F.col("x")).alias("bound"))
        ux, uy = (self.steps[0].select(F.col("node").alias(c), F.col("up").alias(f"u{c}")) for c in "xy")
        q = q.join(ux, "x", "left").join(uy, "y", "left")
        return q.select("a", "b", "is_below", F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("ux") == F.col("uy"), F.col("ux")).alias("bound"))
