"""A trie of paths as a table (node, parent, depth, segment), built and searched a level at a time by joins on node numbers.

No prefix of a path is ever written out: a path moves down one level a round with its place in the trie, and rounds are as many as
the deepest path has segments. Of many paths with one beginning, each level keeps one node, found by a map-side combined aggregate.

The root is node 0 and the empty path. Null paths are left out when built and match nothing; null segments are segments like others;
repeated paths share their nodes. Searches give the deepest marked node on a path's way down, or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.fixpoint import settled


def build(paths: DataFrame) -> DataFrame:
    """(node, parent, depth, segment) of paths (path: array of segments), the root included."""
    spark = paths.sparkSession
    nodes = spark.range(1).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("segment"))
    # Nodes of a level are numbered by their partition and place in it, behind the numbers of the levels before.
    at = settled(paths.where("path is not null").select("path").distinct().withColumn("node", F.lit(0).cast("long")))
    depth, used = 0, 1
    while True:
        left = at.where(F.size("path") > depth)
        found = left.groupBy(F.col("node").alias("parent"), F.get("path", F.lit(depth)).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
        level = settled(found.withColumn("node", F.monotonically_increasing_id() + used).select("node", "parent", F.lit(depth + 1).alias("depth"), "segment"))
        top = level.agg(F.max("node")).collect()[0][0]
        if top is None:
            return nodes
        nodes, used, depth = nodes.union(level), top + 1, depth + 1
        step = level.select("parent", F.col("segment").alias("s"), F.col("node").alias("child"))
        at = settled(left.join(step, (F.col("node") == F.col("parent")) & F.get("path", F.lit(depth - 1)).eqNullSafe(F.col("s"))).select("path", F.col("child").alias("node")))


def places(trie: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, node): the node of each distinct path that the trie has whole."""
    return _down(trie, paths.select("path").distinct().withColumn("id", F.monotonically_increasing_id()), None).where(F.col("depth") == F.size("path")).select("path", F.col("at").alias("node"))


def longest_prefix(trie: DataFrame, marked: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, node, depth) of each row of ``paths`` (id, path): the deepest of ``marked`` (node) on its way, null if there is none."""
    return _down(trie, paths.select("id", "path"), marked).select("id", F.col("best").alias("node"), F.col("best_depth").alias("depth"))


def _down(trie: DataFrame, paths: DataFrame, marked: DataFrame | None) -> DataFrame:
    """(id, path, at, depth, best, best_depth): where each path's way ends, and the deepest marked node on it."""
    marks = trie.select("node").limit(0) if marked is None else marked.select("node").distinct()
    steps = trie.join(marks.withColumn("mark", F.lit(True)), "node", "left").select("node", "parent", "depth", "segment", F.coalesce("mark", F.lit(False)).alias("mark"))
    steps = settled(steps)
    root = steps.where("depth = 0").select(F.col("node").alias("rn"), F.col("mark").alias("rm"))  # one row
    now = paths.crossJoin(F.broadcast(root)).select("id", "path", F.col("rn").alias("at"), F.lit(0).alias("depth"), F.when(F.col("rm") & F.col("path").isNotNull(), F.col("rn")).alias("best"), F.lit(True).alias("open"))
    now = settled(now.withColumn("best_depth", F.when(F.col("best").isNotNull(), 0)))
    done, depth = None, 0
    while not now.isEmpty():
        level = steps.where(F.col("depth") == depth + 1).select(F.col("node").alias("child"), "parent", F.col("segment").alias("s"), "mark")
        more = F.size("path") > depth
        on = now.join(level, (F.col("at") == F.col("parent")) & more & F.get("path", F.lit(depth)).eqNullSafe(F.col("s")), "left")
        went = F.col("child").isNotNull()
        marks_here = went & F.col("mark")
        on = settled(on.select(
            "id", "path", F.coalesce("child", "at").alias("at"), (F.col("depth") + went.cast("int")).alias("depth"), F.when(marks_here, F.col("child")).otherwise(F.col("best")).alias("best"),
            went.alias("open"), F.when(marks_here, F.lit(depth + 1)).otherwise(F.col("best_depth")).alias("best_depth"),
        ))
        stopped = on.where("not open")
        done = stopped if done is None else done.union(stopped)
        now, depth = on.where("open"), depth + 1
    return now if done is None else done


def nearest_marked(trie: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, root): the nearest of ``marked`` (node) at or above each node, null if there is none."""
    nodes = settled(trie.join(marked.select("node").distinct().withColumn("mark", F.lit(True)), "node", "left").select("node", "parent", "depth", "mark"))
    level = settled(nodes.where("depth = 0").select("node", F.when(F.col("mark"), F.col("node")).alias("root")))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        above = level.select(F.col("node").alias("parent"), "root")
        level = settled(nodes.where(F.col("depth") == depth).join(above, "parent").select("node", F.when(F.col("mark"), F.col("node")).otherwise(F.col("root")).alias("root")))
        out = out.union(level)
    return out
