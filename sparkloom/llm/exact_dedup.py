"""Exact deduplication by content sort (DataFrame operations only).

Texts are normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space), sampled splitters
cut the sorted order of (first bytes, digest, id) into ranges, each range is sorted externally
so that equal texts lie side by side, and each text is compared in full with its neighbour.
The identifier is part of the sort key, so a text with any number of copies spreads over as many
ranges as its share of the rows asks for; runs that go on over a range's end are stitched from
two rows a range.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null id sorts
first and so is the one that stays; repeated rows form one group, of which exactly one row is
``kept``; an empty table gives an empty result; extra columns are ignored by
:func:`exact_dedup` and carried by :func:`keep_first`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import SPACE, bucket_of, cut, own_order, packed, sampled_splitters, shuffle_partitions

#: Bytes of the text's beginning in the sort key; the digest orders texts that share them.
PREFIX = 24
KEY = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.LongType())])


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _runs(docs: DataFrame, id_col: str, text_col: str, buckets_per_partition: int) -> DataFrame:
    """Rows (id, sha, b, run, first, start, len): run ``run`` of range ``b`` holds equal texts and starts at id ``start``."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("x"))
    key = lambda t: F.concat(F.hex(F.substring(t.cast("binary"), 1, PREFIX)), F.lit("|"), F.sha2(t, 256))
    splitters = sampled_splitters(src, {"k": key(normalised(F.col("x"))), "i": F.col("i")}, shuffle_partitions(spark) * buckets_per_partition)
    rows = src.select("i", normalised(F.col("x")).alias("t")).withColumn("k", key(F.col("t")))
    rows = rows.withColumn("b", bucket_of(splitters, {"k": F.col("k"), "i": F.col("i")}, KEY))
    w = Window.partitionBy("b").orderBy("k", "t", F.col("i").asc_nulls_first())
    rows = rows.withColumn("first", ~F.coalesce(F.lag("t").over(w) == F.col("t"), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select("i", F.unhex(F.substring_index("k", "|", -1)).alias("sha"), "b", "run", "first")
    r = Window.partitionBy("b", "run")
    return rows.withColumn("len", F.count(F.lit(1)).over(r)).withColumn("start", F.min(F.struct((~F.col("first")).alias("o"), F.col("i").alias("i"))).over(r)["i"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets_per_partition: int = 8) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = cut(_runs(docs, id_col, text_col, buckets_per_partition))
    # A run can go on in another range only if it is the first or the last of its own.
    ends = rows.groupBy("b").agg(F.max("run").alias("n"))
    ends = rows.where("first or run = 1").join(F.broadcast(ends.withColumnRenamed("b", "eb")), F.col("b") == F.col("eb")).where("run = 1 or run = n")
    ends = ends.groupBy("b", "run").agg(F.first("sha").alias("sha"), F.first("len").alias("len"), F.min(F.struct((~F.col("first")).alias("o"), F.col("i").alias("i")))["i"].alias("start"))
    w = Window.orderBy("b", "run")  # two rows a range
    ends = ends.withColumn("g", F.sum((~F.coalesce(F.lag("sha").over(w) == F.col("sha"), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy("g").orderBy("b", "run")
    every = g.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(F.col("b").alias("eb"), F.col("run").alias("er"), F.first("start").over(every).alias("gstart"), F.sum("len").over(every).alias("glen"), (F.row_number().over(g) == 1).alias("ghead"))
    out = rows.join(F.broadcast(ends), (F.col("b") == F.col("eb")) & (F.col("run") == F.col("er")), "left")
    return out.select(
        F.col("i").alias(id_col),
        F.when(F.col("ghead").isNull(), F.col("start")).otherwise(F.col("gstart")).alias("keep_id"),
        F.coalesce("glen", "len").alias("group_size"),
        (F.col("first") & F.coalesce("ghead", F.lit(True))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that share id and text, the first in the order of their columns."""
    kept = exact_dedup(docs.select(id_col, text_col), id_col, text_col).where("kept").select(F.col(id_col).alias("__i"), F.col("text_sha256").alias("__s"))
    rows = packed(docs, i=F.col(id_col).cast("long"), h=F.sha2(normalised(F.col(text_col)), 256))
    rows = rows.join(kept, rows.i.eqNullSafe(kept["__i"]) & (rows.h == kept["__s"]), "left_semi")
    once = Window.partitionBy("h", "i").orderBy(own_order(rows))
    return rows.withColumn("once", F.row_number().over(once)).where("once = 1").select("row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
