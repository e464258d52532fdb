"""Indexed files: a base sorted by key in blocks, a table of each block's least key, and runs of later changes.

A change (insert, rewrite, delete) writes one small run of records and tombstones, each with the number of
its run; the base is not touched. Whoever reads takes, for each key, the row of the latest run, the base being run 0. Runs are
dealt to the same blocks as the base, so a read by key, a start or a step to the next record opens only the
blocks that its keys lie in, of the base and of each run; :meth:`IndexedFile.compact` makes a new base when runs have grown.

Statuses: 00 done, 10 end, 22 key is there already, 23 no such record. Of several new records with one key the first by
record is inserted, the greatest is rewritten; null keys are refused with 23; keys compare by their bytes. The
least keys of the blocks (one for about ``BLOCK_ROWS`` records) are the only keys that reach the driver and go with the tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.plans.fixpoint import checkpointed, shared_dir
from sparkloom.sources.records import DUPLICATE, MISSING, OK

BLOCK_ROWS = 50_000


class IndexedFile:
    """An indexed file in ``folder``; ``runs`` are the folders of its base (first) and of its changes, oldest first."""

    def __init__(self, spark: SparkSession, folder: str, runs: list[str], lows: list):
        self.spark, self.folder, self.runs, self.lows = spark, folder, runs, lows

    @classmethod
    def create(cls, records: DataFrame, folder: str | None = None, block_rows: int | None = None) -> IndexedFile:
        """A new file from ``records`` (key, record); of rows with one key the least record is kept."""
        spark = records.sparkSession
        folder = folder or f"{shared_dir(spark).rstrip('/')}/indexed-{uuid.uuid4().hex}"
        rows = records.where("key is not null").groupBy("key").agg(F.min("record").alias("record"))
        return cls(spark, folder, [], [])._based(rows, block_rows or BLOCK_ROWS)

    def _based(self, rows: DataFrame, block_rows: int) -> IndexedFile:
        rows = checkpointed(rows)
        blocks = max(1, -(-rows.count() // block_rows))
        self.block_rows = block_rows
        ranged = checkpointed(rows.repartitionByRange(blocks, "key").withColumn("p", F.spark_partition_id()))
        # The splitters of the blocks: one key a block reaches the driver.
        self.lows = [r["low"] for r in ranged.groupBy("p").agg(F.min("key").alias("low")).orderBy("low").collect()][1:]
        self.runs = [self._write(ranged.select("key", "record", F.lit(False).alias("gone")))]
        return self

    def _block(self, key: Column) -> Column:
        """The block of a key: how many of the blocks' least keys, but for the first's, are not above it."""
        from bisect import bisect_right

        import pandas as pd
        from pyspark.sql.types import IntegerType

        lows = self.lows
        if not lows:
            return F.lit(0)
        if len(lows) <= 64:
            return sum(F.when(key >= F.lit(low), 1).otherwise(0) for low in lows)
        return F.pandas_udf(lambda s: pd.Series([bisect_right(lows, k) for k in s], dtype="int32"), IntegerType())(key)

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        dealt = rows.withColumn("block", self._block(F.col("key"))).repartition("block").sortWithinPartitions("block", "key")
        dealt.write.partitionBy("block").parquet(path)
        return path

    def _rows(self, blocks: list[int] | None = None) -> DataFrame:
        """The latest row of each key, in the given blocks."""
        out = None
        for n, path in enumerate(self.runs):
            run = self.spark.read.schema("key string, record string, gone boolean, block int").parquet(path)
            if blocks is not None:
                run = run.where(F.col("block").isin(blocks))
            run = run.withColumn("run", F.lit(n))
            out = run if out is None else out.unionByName(run)
        if len(self.runs) == 1:
            return out.where("not gone").select("key", "record", "block")
        last = out.groupBy("key", "block").agg(F.max(F.struct("run", "gone", "record")).alias("last"))
        return last.where("not last.gone").select("key", "last.record", "block")

    def scan(self) -> DataFrame:
        """(key, record) of the whole file."""
        return self._rows().select("key", "record")

    def _asked(self, keys: DataFrame) -> tuple[DataFrame, list[int]]:
        """``keys`` with their blocks, and the distinct blocks (at most as many as the file has)."""
        keys = checkpointed(keys.withColumn("block", self._block(F.col("key"))))
        return keys, sorted(r["block"] for r in keys.select("block").where("block is not null").distinct().collect())

    def read(self, keys: DataFrame) -> DataFrame:
        """(key, record, status) of each row of ``keys`` (key)."""
        keys, blocks = self._asked(keys.select("key"))
        there = self._rows(blocks).select(F.col("key").alias("k"), "record")
        return keys.join(there, F.col("key") == F.col("k"), "left").select("key", "record", F.when(F.col("k").isNull(), MISSING).otherwise(OK).alias("status"))

    def _changed(self, rows: DataFrame) -> None:
        if not rows.isEmpty():
            self.runs = [*self.runs, self._write(rows)]

    def insert(self, new: DataFrame) -> DataFrame:
        """(key, record, status) of each row of ``new`` (key, record); those with status 00 are in the file now."""
        new, blocks = self._asked(new.select("key", "record"))
        there = self._rows(blocks).select(F.col("key").alias("k"))
        nth = F.row_number().over(Window.partitionBy("key").orderBy("record"))
        told = new.withColumn("nth", nth).join(there, F.col("key") == F.col("k"), "left")
        status = F.when(F.col("key").isNull(), MISSING).when(F.col("k").isNull() & (F.col("nth") == 1), OK).otherwise(DUPLICATE)
        told = checkpointed(told.select("key", "record", status.alias("status")))
        self._changed(told.where(F.col("status") == OK).select("key", "record", F.lit(False).alias("gone")))
        return told

    def rewrite(self, new: DataFrame) -> DataFrame:
        """(key, status) of each key of ``new`` (key, record)."""
        return self._over(new.groupBy("key").agg(F.max("record").alias("record")), False)

    def delete(self, keys: DataFrame) -> DataFrame:
        """(key, status) of each key of ``keys`` (key)."""
        return self._over(keys.select("key").distinct().withColumn("record", F.lit(None).cast("string")), True)

    def _over(self, new: DataFrame, gone: bool) -> DataFrame:
        new, blocks = self._asked(new)
        there = self._rows(blocks).select(F.col("key").alias("k"))
        told = new.join(there, F.col("key") == F.col("k"), "left")
        told = checkpointed(told.select("key", "record", F.when(F.col("k").isNull(), MISSING).otherwise(OK).alias("status")))
        self._changed(told.where(F.col("status") == OK).select("key", "record", F.lit(gone).alias("gone")))
        return told.select("key", "status")

    def start(self, key: str, how: str = ">=", rows: int = 1) -> DataFrame:
        """(key, record) of the next ``rows`` records whose key is =, > or >= ``key``, in order: START and READ NEXT.

        Blocks are opened one after the other until enough live records are found.
        """
        from bisect import bisect_right

        k = F.col("key")
        fits = {"=": k == key, ">": k > key, ">=": k >= key}[how]
        first = last = bisect_right(self.lows, key)
        while True:
            found = self._rows(list(range(first, last + 1))).where(fits).select("key", "record").orderBy("key").limit(rows)
            if how == "=" or last >= len(self.lows) or found.count() >= rows:
                return found
            last = min(len(self.lows), 2 * last - first + 1)

    def compact(self) -> IndexedFile:
        """The same file with one new base; old runs stay for those who still read them."""
        return self._based(self.scan(), self.block_rows)
