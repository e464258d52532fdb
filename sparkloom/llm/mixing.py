"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Sources in code-point order (null last) weigh 3, 1, 2, 3, ... and share ``budget`` times all words;
a target stops at ``most`` times its source's size and the excess is shared anew by weight. Each
source's documents are shuffled (by a digest of seed and id) and run through up to ``most`` times;
a document's virtual finish time is the source's words up to and with it, divided by the target.
All finish times are range-sorted together and cut where the words reach the total budget.

No window holds a whole source: the running sum of a source is taken in 4,096 slices of the
shuffle digest, the global order in sampled ranges, each with the total of those before it. The
sources table (one row a source) is handled in one task and broadcast up to ``MANY_SOURCES`` rows; beyond
that its sums are taken in ranges too and it is joined by shuffle.

Defined cases: a null or empty text has size 0 and takes nothing (times 0); null ids and repeated
rows are documents of their own; a source without words has target 0; an empty table gives
an empty result; other columns are ignored, or carried by :func:`mixed`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import WORD, cut, packed, range_prefix_sum, shuffle_partitions

WEIGHTS = (3, 1, 2)
#: Hexadecimal digits of the shuffle digest that name a slice of a source.
DIGITS = 3
MANY_SOURCES = 100_000


def shuffle_key(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, budget: tuple[int, int], most: int) -> DataFrame:
    """(s, n, target) of (s, n). Water filling: sources in ascending order of size by weight meet their cap first.

    Whole numbers until the last division, so that every engine gets the same double.
    """
    a, b = budget
    lcm = math.lcm(*WEIGHTS)
    weight = lambda r: F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((r - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    few = sizes.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES
    every = Window.partitionBy(F.lit(0))
    if few:
        t = sizes.select("s", "n", F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())).alias("r"))
        t = t.withColumn("w", weight(F.col("r")))
        order = Window.orderBy(F.col("n") * F.floor(F.lit(lcm) / F.col("w")), "r")
        t = t.withColumns({
            "all_n": F.sum("n").over(every),
            "n_before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "w_from": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        })
    else:
        parts = shuffle_partitions(sizes.sparkSession)
        named = T.StructType([T.StructField("z", T.BooleanType()), T.StructField("s", T.StringType())])
        t = range_prefix_sum(sizes.select("s", "n", F.lit(1).cast("long").alias("one")), {"z": F.col("s").isNull(), "s": F.coalesce("s", F.lit(""))}, named, "one", [], "r", parts)
        t = cut(t.withColumn("w", weight(F.col("r"))))
        sums = t.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()[0]
        filled = T.StructType([T.StructField("f", T.LongType()), T.StructField("r", T.LongType())])
        order = {"f": F.col("n") * F.floor(F.lit(lcm) / F.col("w")), "r": F.col("r")}
        for value, out in (("n", "n_upto"), ("w", "w_upto")):
            t = range_prefix_sum(t, order, filled, value, [], out, parts)
        t = t.withColumns({"all_n": F.lit(sums["n"]), "n_before": F.col("n_upto") - F.col("n"), "w_from": F.lit(sums["w"]) - F.col("w_upto") + F.col("w")})
    # left for this source and those after it, times b: a * all - b * most * n_before
    t = t.withColumn("capped", F.lit(b * most) * F.col("n") * F.col("w_from") <= F.col("w") * (F.lit(a) * F.col("all_n") - F.lit(b * most) * F.col("n_before")))
    capped = {"n_capped": F.sum(F.when(F.col("capped"), F.col("n")).otherwise(0)), "w_free": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w")))}
    if few:
        t = t.withColumns({k: v.over(every) for k, v in capped.items()})
    else:
        t = cut(t)
        t = t.withColumns({k: F.lit(v) for k, v in t.agg(*[v.alias(k) for k, v in capped.items()]).collect()[0].asDict().items()})
    free = (F.col("w") * (F.lit(a) * F.col("all_n") - F.lit(b * most) * F.col("n_capped"))).cast("double") / (F.lit(b) * F.col("w_free")).cast("double")
    return t.select("s", "n", F.when(F.col("capped"), (F.lit(most) * F.col("n")).cast("double")).otherwise(free).alias("target"))


def _queued(rows: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """``rows`` (with __s, __size, __h) with source_size, target and __cum, the source's words up to and with the row."""
    ties = [F.col(k).asc_nulls_first() for k in keys]
    slice_ = F.substring("__h", 1, DIGITS)
    rows = rows.withColumn("__slice", slice_)
    w = Window.partitionBy("__s", "__slice").orderBy("__h", *ties, "__size").rowsBetween(Window.unboundedPreceding, 0)
    slices = rows.groupBy("__s", "__slice").agg(F.sum("__size").alias("n"))
    before = slices.select(F.col("__s").alias("bs"), F.col("__slice").alias("bq"), F.coalesce(F.sum("n").over(Window.partitionBy("__s").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.withColumn("__own", F.sum("__size").over(w)).join(before, F.col("__s").eqNullSafe(F.col("bs")) & (F.col("__slice") == F.col("bq")))
    table = table.select(F.col("s").alias("ts"), F.col("n").alias("source_size"), "target")
    few = table.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES
    rows = rows.join(F.broadcast(table) if few else table, F.col("__s").eqNullSafe(F.col("ts")))
    return rows.withColumn("__cum", F.col("__own") + F.col("before")).drop("__slice", "__own", "bs", "bq", "before", "ts")


def weighted_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix:") -> DataFrame:
    """One row for each row of ``docs``: id, source, size, source_size, target, times, taken (= times * size).

    ``budget`` is a fraction of all words (numerator, denominator).
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    src = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__s"), size.alias("__size"), shuffle_key(F.col(id_col), seed).alias("__h"))
    src = cut(src)  # the texts are read once
    table = cut(targets(cut(src.groupBy("__s").agg(F.sum("__size").alias("n")).select(F.col("__s").alias("s"), "n")), budget, most))
    rows = cut(_queued(src, ["__id"], table))
    finish = [((F.lit(e) * F.col("source_size") + F.col("__cum")).cast("double") / F.col("target")) for e in range(most)]
    queue = rows.where("__size > 0").select("__s", "__size", "__h", "__id", F.posexplode(F.array(*finish)).alias("e", "f"))
    total = table.agg(F.sum("target").alias("t")).collect()[0]["t"] or 0.0
    summed = range_prefix_sum(queue, {"f": F.col("f")}, T.StructType([T.StructField("f", T.DoubleType())]), "__size", [F.col("__s").asc_nulls_last(), F.col("e"), F.col("__h"), F.col("__id").asc_nulls_first()], "__sum", shuffle_partitions(spark) * 8)
    # Rows past the budget are as far back as rows can be: the last row that fits is the cut (one row reaches the driver).
    place = F.struct(F.col("f"), F.col("__s").isNull().alias("z"), F.col("__s").alias("s"), F.col("e"), F.col("__h").alias("h"))
    last = summed.where(F.col("__sum") <= F.lit(total)).agg(F.max(place).alias("m")).collect()[0]["m"]
    if last is None:
        times = F.lit(0)
    else:
        edge = F.struct(F.lit(last["f"]).alias("f"), F.lit(last["z"]).alias("z"), F.lit(last["s"]).cast("string").alias("s"), F.lit(last["e"]).alias("e"), F.lit(last["h"]).alias("h"))
        times = sum((F.struct(f.alias("f"), F.col("__s").isNull().alias("z"), F.col("__s").alias("s"), F.lit(e).alias("e"), F.col("__h").alias("h")) <= edge).cast("int") for e, f in enumerate(finish))
        times = F.when(F.col("__size") > 0, times).otherwise(0)
    return rows.withColumn("times", times).select(F.col("__id").alias(id_col), F.col("__s").alias(source_col), F.col("__size").alias("size"), "source_size", "target", "times", (F.col("times") * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with all columns, each row as often as the mix takes it.

    Rows that share id, source and size (repeated rows) share the decision of each other's copies.
    """
    how = weighted_mix(docs.select(id_col, text_col, source_col), id_col, text_col, source_col).where("times > 0")
    how = how.groupBy(F.col(id_col).alias("__i"), F.col(source_col).alias("__s"), F.col("size").alias("__n")).agg(F.max("times").alias("__times"))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = packed(docs, i=F.col(id_col), s=F.col(source_col), n=size)
    rows = rows.join(how, rows.i.eqNullSafe(how["__i"]) & rows.s.eqNullSafe(how["__s"]) & (rows.n == how["__n"]))
    return rows.withColumn("time", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return weighted_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
), wt AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM src),
acc AS (
  SELECT *, sum(n) OVER () AS all_n,
    coalesce(sum(n) OVER (ORDER BY n * (6 // w), r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before,
    sum(w) OVER (ORDER BY n * (6 // w), r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM wt
), cap AS (SELECT *, 4 * n * w_from <= w * (3 * all_n - 4 * n_before) AS capped FROM acc),
tot AS (
  SELECT *, sum(CASE WHEN capped THEN n ELSE 0 END) OVER () AS n_capped, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS w_free FROM cap
), tg AS (
  SELECT source, n, CASE WHEN capped THEN CAST(2 * n AS DOUBLE)
    ELSE CAST(w * (3 * all_n - 4 * n_capped) AS DOUBLE) / CAST(2 * w_free AS DOUBLE) END AS target FROM tot
), q AS (
  SELECT d.*, tg.n AS source_size, tg.target,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source
), e AS (
  SELECT doc_id, source, size, h, x.e AS e, CAST(x.e * source_size + cum AS DOUBLE) / target AS f
  FROM q, (VALUES (0), (1)) AS x(e) WHERE size > 0
), s AS (
  SELECT *, sum(size) OVER (ORDER BY f, source NULLS LAST, e, h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS total FROM e
), k AS (
  SELECT doc_id, source, CAST(sum(size) AS BIGINT) AS taken FROM s
  WHERE total <= (SELECT sum(target) FROM tg) GROUP BY doc_id, source
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source
"""
