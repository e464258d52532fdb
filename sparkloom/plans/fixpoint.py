"""Fixpoints over edge tables.

Two forms. Graphs that stay within a key (a program) are solved by one job: each key
is one small graph and needs one shuffle. Graphs that cross keys, or have over ``GROUP_ROWS`` rows, are solved by semi-naive
rounds of joins; every round is written to the shared checkpoint folder, so a lost executor costs
a re-read and the plan never grows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import deque
from contextvars import ContextVar
from functools import wraps
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where or tempfile.mkdtemp(prefix="sparkloom-")


def checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there; the files go when the driver ends.

    For rounds that join a table with itself: a checkpoint keeps the size that the optimizer guessed for its plan, and the
    guess of a join is the product of its sides, a number that doubles its digits in every such round.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: The shared tables of the query that runs in this thread or task of the driver.
_tables: ContextVar[dict | None] = ContextVar("tables", default=None)


def once(name: str, make) -> DataFrame:
    """The table ``make`` gives, written to the shared folder the first time the running query asks for it and read from there after that."""
    tables = _tables.get()
    if tables is None:  # not inside a query
        return checkpointed(make())
    if name not in tables:
        tables[name] = checkpointed(make())
    return tables[name]


def scoped(query):
    """``query`` (spark, sf_dir) with its own shared tables: nothing is kept from one query to the next, and queries in other threads have theirs."""

    @wraps(query)
    def run(spark, sf):
        token = _tables.set({})
        try:
            return query(spark, sf)
        finally:
            _tables.reset(token)

    return run


def reach(seeds: DataFrame, edges: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """(keys, node, depth): nodes reached from ``seeds`` (keys, node) over ``edges`` (keys, src, dst), each at its least depth."""
    edges = checkpointed(edges.select(*keys, "src", "dst").distinct())
    new = checkpointed(seeds.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    seen = new
    for depth in range(1, most):
        hop = new.join(edges.withColumnRenamed("src", "node"), [*keys, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
        new = checkpointed(hop.join(seen, [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return seen
        seen = checkpointed(seen.union(new)) if depth % 8 == 0 else seen.union(new)
    raise RuntimeError("the fixpoint did not settle")


def closure(edges: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """(keys, src, dst): all pairs joined by a path of one edge or more, by semi-naive rounds."""
    edges = checkpointed(edges.select(*keys, "src", "dst").distinct())
    new = seen = edges
    step = edges.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("to"))
    for k in range(most):
        hop = new.join(step, [*keys, "dst"]).select(*keys, "src", F.col("to").alias("dst")).distinct()
        new = checkpointed(hop.join(seen, [*keys, "src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = checkpointed(seen.union(new)) if k % 8 == 7 else seen.union(new)
    raise RuntimeError("the fixpoint did not settle")


def apart(df: DataFrame, *columns: str) -> DataFrame:
    """The columns under fresh identities, so that tables with one origin can be cogrouped."""
    return df.select(*[F.col(c).alias(c) for c in columns])


#: Keys with more rows than this are solved by rounds of joins, not in one task.
GROUP_ROWS = 1_000_000


def split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(rows of keys that fit a task, rows of the others or null, all rows), read from the shared folder."""
    df = checkpointed(df)
    big = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > GROUP_ROWS).select(key)
    if big.isEmpty():
        return df, None, df
    return df.join(big, key, "left_anti"), df.join(big, key, "left_semi"), df


def per_key(df: DataFrame, key: str, solve, schema: str) -> DataFrame:
    """Rows (key, *row) for each row that ``solve`` gives for a key's rows (a list of their other columns, in order).

    One shuffle and one sort; a task goes through its keys in order and holds one key's rows at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches):
        import pyarrow as pa

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        out = []
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for name, group in groupby(rows, itemgetter(0)):
            for row in solve([r[1:] for r in group]):
                out.append((name, *row))
                if len(out) == 10_000:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    return df.select(key, *[c for c in df.columns if c != key]).repartition(key).sortWithinPartitions(key).mapInArrow(work, schema)


def _adjacency(pairs):
    out: dict = {}
    for s, d in pairs:
        out.setdefault(s, []).append(d)
    return out


def closure_by_key(edges: DataFrame, key: str) -> DataFrame:
    """(key, src, dst): as :func:`closure`, each key's graph in one task; keys of over ``GROUP_ROWS`` edges by rounds."""
    kind = edges.schema[key].dataType.simpleString()

    def solve(rows):
        adj = _adjacency(rows)
        for s in adj:
            seen, todo = set(), list(adj[s])
            while todo:
                d = todo.pop()
                if d not in seen:
                    seen.add(d)
                    todo += adj.get(d, ())
                    yield s, d

    small, big, _ = split(edges.select(key, "src", "dst"), key)
    out = per_key(small, key, solve, f"{key} {kind}, src string, dst string")
    return out if big is None else out.union(closure(big, [key]))


def reach_by_key(edges: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """(key, node, depth): breadth-first from each key's seeds, in one task a key; keys of over ``GROUP_ROWS`` rows by rounds."""
    kind = edges.schema[key].dataType.simpleString()

    def solve(rows):
        adj = _adjacency((s, d) for s, d in rows if d is not None)
        depth = {s: 0 for s, d in rows if d is None}
        todo = deque(depth)
        while todo:
            x = todo.popleft()
            for d in adj.get(x, ()):
                if d not in depth:
                    depth[d] = depth[x] + 1
                    todo.append(d)
        return depth.items()

    both = edges.select(key, "src", "dst").where("dst is not null").union(seeds.select(key, "node", F.lit(None).cast("string")))
    small, big, _ = split(both, key)
    out = per_key(small, key, solve, f"{key} {kind}, node string, depth int")
    return out if big is None else out.union(reach(big.where("dst is null").select(key, F.col("src").alias("node")), big.where("dst is not null"), [key]))


def components_by_key(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, scc): strongly connected components, named by their smallest node, of every node of an edge; keys of over ``GROUP_ROWS`` edges by rounds."""
    kind = edges.schema[key].dataType.simpleString()

    def solve(rows):
        adj = _adjacency(rows)
        index, low, on, stack = {}, {}, set(), []
        for root in sorted({x for r in rows for x in r}):
            if root in index:
                continue
            work = [(root, iter(adj.get(root, ())))]
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
            while work:
                v, it = work[-1]
                for d in it:
                    if d not in index:
                        index[d] = low[d] = len(index)
                        stack.append(d)
                        on.add(d)
                        work.append((d, iter(adj.get(d, ()))))
                        break
                    if d in on:
                        low[v] = min(low[v], index[d])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == index[v]:
                        group = stack[stack.index(v) :]
                        del stack[stack.index(v) :]
                        on.difference_update(group)
                        least = min(group)
                        yield from ((x, least) for x in group)

    small, big, _ = split(edges.select(key, "src", "dst"), key)
    out = per_key(small, key, solve, f"{key} {kind}, node string, scc string")
    if big is None:
        return out
    both = closure(big, [key])
    mutual = both.join(both.select(key, F.col("src").alias("dst"), F.col("dst").alias("src")), [key, "src", "dst"]).groupBy(key, F.col("src").alias("node")).agg(F.min("dst").alias("least"))
    nodes = big.select(key, F.col("src").alias("node")).union(big.select(key, "dst")).distinct()
    return out.union(nodes.join(mutual, [key, "node"], "left").select(key, "node", F.least("node", F.coalesce("least", "node"))))


def cycle_by_key(edges: DataFrame, key: str) -> DataFrame:
    """(key, cycle): a shortest cycle through the least node that lies on one, from that node back to it; no row for keys without cycles."""
    kind = edges.schema[key].dataType.simpleString()

    def solve(rows):
        adj = {s: sorted(set(d)) for s, d in _adjacency(rows).items()}
        for start in sorted(adj):
            came, todo = {}, deque([start])
            while todo and start not in came:
                x = todo.popleft()
                for d in adj.get(x, ()):
                    if d not in came:
                        came[d] = x
                        todo.append(d)
            if start in came:
                path, x = [start], came[start]
                while x != start:
                    path.append(x)
                    x = came[x]
                yield ([start, *reversed(path)],)
                return

    return per_key(edges.select(key, "src", "dst"), key, solve, f"{key} {kind}, cycle array<string>")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): dependencies (src needs dst) first; nodes on or above a cycle get the level after the last.

    A round counts the edges into the nodes of the last level for each of their users; a user whose count is whole is next. Every edge
    is counted once, only users that still wait are carried on, and no side of a join is broadcast, however small it is guessed.
    """
    spark = edges.sparkSession
    nodes = settled(nodes.select("node").distinct())
    known = lambda c: nodes.select(F.col("node").alias(c)).hint("merge")
    edges = settled(edges.select("src", "dst").distinct().join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi"))
    need = edges.groupBy("src").agg(F.count(F.lit(1)).alias("need"))
    ready = settled(nodes.join(need.select(F.col("src").alias("node")).hint("merge"), "node", "left_anti"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    users = checkpointed(edges.join(need.hint("merge"), "src").select("dst", F.col("src").alias("node"), "need").repartition(parts, "dst").sortWithinPartitions("dst"))
    done, waiting, level = ready.withColumn("level", F.lit(0)), None, 0
    while not ready.isEmpty():
        level += 1
        got = users.join(ready.select(F.col("node").alias("dst")).hint("merge"), "dst").select("node", "need", F.lit(1).cast("long").alias("got"))
        got = (got if waiting is None else waiting.union(got)).groupBy("node", "need").agg(F.sum("got").alias("got"))
        counted = settled(got)
        ready, waiting = counted.where("got = need").select("node"), counted.where("got < need")
        done = done.union(ready.withColumn("level", F.lit(level)))
        if level % 32 == 0:
            done = settled(done)
    rest = nodes.where("node is not null").join(done.select("node").hint("merge"), "node", "left_anti")
    return done.union(rest.withColumn("level", F.lit(level)))


def shortest_paths(edges: DataFrame, starts: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """(keys, start, node, path): one shortest path to each node, the least in array order among equals."""
    edges = checkpointed(edges.select(*keys, "src", "dst").distinct())
    new = checkpointed(starts.select(*keys, F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct())
    seen = new
    for k in range(1, most):
        hop = new.join(edges.withColumnRenamed("src", "node"), [*keys, "node"]).select(*keys, "start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        hop = hop.groupBy(*keys, "start", "node").agg(F.min("path").alias("path"))
        new = checkpointed(hop.join(seen.select(*keys, "start", "node"), [*keys, "start", "node"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = checkpointed(seen.union(new)) if k % 8 == 0 else seen.union(new)
    raise RuntimeError("the fixpoint did not settle")
