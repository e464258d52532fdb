"""Shared pieces: shared-folder checkpoints, sampled range splitters, distributed prefix sums."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java regex of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="sparkloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: survives lost executors, cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df``'s rows as one column ``row``, so that no name of theirs can clash, beside ``columns``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def own_order(packed_rows: DataFrame) -> Column:
    """An order of packed rows by all their columns, so that a choice among them is the same in every run."""
    return F.to_json("row") if any(k in packed_rows.schema["row"].dataType.simpleString() for k in ("map<", "variant")) else F.col("row")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def sampled_splitters(df: DataFrame, keys: dict[str, Column], buckets: int, per_bucket: int = 6, seed: int = 7) -> list:
    """At most ``buckets - 1`` distinct key tuples of ``df``, ascending in Spark's own order, from a sample of all its rows.

    Only the splitters' keys reach the driver: ``buckets * per_bucket`` rows at most (120,000, whatever the input).
    """
    want = min(120_000, buckets * per_bucket)
    n = df.count()
    if n == 0 or buckets <= 1:
        return []
    rows = df.sample(False, min(1.0, want / n), seed) if n > want else df  # before the keys are worked out
    rows = sorted_rows(rows.select(*[c.alias(k) for k, c in keys.items()]), list(keys))
    out: list = []
    for r in (rows[j * len(rows) // buckets] for j in range(1, buckets) if rows):
        if not out or tuple(out[-1]) != tuple(r):
            out.append(r)
    return out


def sorted_rows(rows: DataFrame, keys: list[str]) -> list:
    """A bounded sample, sorted in one task: a global sort would scan the table once more to find its ranges."""
    return rows.repartition(1).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).collect()


def bucket_of(splitters: list, keys: dict[str, Column], schema: T.StructType) -> Column:
    """Number of splitters at or below the key: a binary search over a literal array, log2(n) steps a row."""
    if not splitters:
        return F.lit(0)
    text = json.dumps([r.asDict(recursive=True) for r in splitters])
    table = F.from_json(F.lit(text), T.ArrayType(schema))
    steps, s = [], 1
    while s <= len(splitters):
        steps.append(s)
        s *= 2
    key = F.struct(*[keys[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    return F.aggregate(
        F.array(*[F.lit(x) for x in reversed(steps)]),
        F.lit(0),
        lambda lo, step: F.when(F.coalesce(F.get(table, lo + step - 1) <= key, F.lit(False)), lo + step).otherwise(lo),
    )


def range_prefix_sum(df: DataFrame, order: dict[str, Column], schema: T.StructType, value: str, ties: list[Column], out: str, buckets: int) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows up to and with this one in the order of ``order`` and ``ties``.

    Sampled splitters cut the order into ranges; each range is summed by itself and then gets
    the total of the ranges before it (a table of ``buckets`` rows).
    """
    spl = sampled_splitters(df, order, buckets)
    b = df.withColumn("__b", bucket_of(spl, order, schema))
    w = Window.partitionBy("__b").orderBy(*[c.asc_nulls_first() for c in order.values()], *ties).rowsBetween(Window.unboundedPreceding, 0)
    totals = b.groupBy("__b").agg(F.sum(value).alias("__t"))
    before = totals.select(
        F.col("__b").alias("__tb"),
        F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    return b.withColumn("__own", F.sum(value).over(w)).join(F.broadcast(before), F.col("__b") == F.col("__tb")).withColumn(out, F.col("__own") + F.col("__before")).drop("__b", "__tb", "__own", "__before")


def slices(batch, size: int, column: int = 1):
    """Slices of an Arrow batch with at most ``size`` bytes in a column of strings or bytes, one row at least."""
    import pyarrow.compute as pc

    at, sizes = 0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    while at < len(sizes):
        end, now = at + 1, sizes[at]
        while end < len(sizes) and now + sizes[end] <= size:
            now += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def first_by_digest(ids: DataFrame, most: int) -> DataFrame:
    """The ``most`` first different ``i`` of ``ids`` in the order of their digest, found without sending ``most`` rows of every task to the driver."""
    digest = F.md5(F.col("i").cast("string").cast("binary"))
    n = ids.count()
    if n > 4 * most:  # twice as many as needed lie below this bound, give or take a few percent
        ids = ids.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(2**32 * 2 * most / n))
    return ids.orderBy(digest, "i").limit(most)


def largest_counts(counted: DataFrame, count: str, most: int) -> DataFrame:
    """``most`` rows with large ``count``: all of the highest powers of two that fit, and of the next power a part chosen by a digest, so that no task sends ``most`` rows."""
    others = [c for c in counted.columns if c != count]
    counted = counted.withColumn("__level", F.floor(F.log2(F.col(count))).cast("int"))
    sizes = sorted(((r[0], r[1]) for r in counted.groupBy("__level").count().collect()), reverse=True)  # 63 rows at most
    full, room = [], most
    for at, n in sizes:
        if n > room:
            share = F.pmod(F.xxhash64(*others), F.lit(1 << 20)) <= F.lit((1 << 20) * room // n)
            part = counted.where((F.col("__level") == at) & share).orderBy(F.desc(count), *others).limit(room)
            return counted.where(F.col("__level").isin(full)).union(part).drop("__level")
        full.append(at)
        room -= n
    return counted.drop("__level")
