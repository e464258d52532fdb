"""Keyed record files as tables: sequential, indexed and relative access with file status codes.

A file is a table of records with its key; every operation is one scan, join or anti-join over it, so files of any size
work and an operation's cost does not depend on the position of the record. Status: 00 done, 10 end,
22 key is there already, 23 no such record, 35 no such file, 47 not open for input, 48 not open for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OK, END, DUPLICATE, MISSING, NO_FILE, NOT_INPUT, NOT_OUTPUT = "00", "10", "22", "23", "35", "47", "48"


def read_sequential(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, nth, record) of fixed-length records; the last may be short."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    parts = F.expr(f"transform(sequence(0, cast(ceil(length / {size}) as int) - 1), n -> substring(content, n * {size} + 1, {size}))")
    return files.where("length > 0").select("path", F.posexplode(parts).alias("nth", "record"))


def append(file: DataFrame, new: DataFrame) -> DataFrame:
    """Sequential (part, nth, record) with the records of ``new`` (nth, record) after all others, as the next part."""
    last = file.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("part"))  # one row
    return file.select("part", "nth", "record").union(new.crossJoin(F.broadcast(last)).select("part", "nth", "record"))


def rewrite_last(file: DataFrame, record) -> DataFrame:
    """The record read last, at the end of (part, nth), replaced."""
    last = file.agg(F.max(F.struct("part", "nth")).alias("at"))
    changed = F.when(F.struct("part", "nth") == F.col("at"), record).otherwise(F.col("record"))
    return file.crossJoin(F.broadcast(last)).select("part", "nth", changed.alias("record"))


def key_of(record, offset: int, size: int) -> Column:
    return F.substring(record, offset + 1, size)


def read_key(file: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (key) with its record and status 00, or 23."""
    f = file.select(F.col("key").alias("fk"), "record")
    return requests.join(f, requests.key == f.fk, "left").select("key", "record", F.when(F.col("fk").isNull(), MISSING).otherwise(OK).alias("status"))


def start(file: DataFrame, key, how: str = ">=") -> DataFrame:
    """The record at which reading goes on: the first whose key is =, > or >= ``key``."""
    k = F.col("key")
    return file.where({"=": k == key, ">": k > key, ">=": k >= key}[how]).orderBy("key").limit(1)


def neighbours(file: DataFrame, keys: list[str], buckets: int = 64) -> DataFrame:
    """``file`` with next_key and prev_key in the order of ``keys[-1]`` within ``keys[:-1]``."""
    w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
    return file.withColumns({"next_key": F.lead(keys[-1]).over(w), "prev_key": F.lag(keys[-1]).over(w)})


def insert(file: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, told): records with new keys are written (00), the others are not (22); of equal new keys the first by record is."""
    w = Window.partitionBy("key").orderBy("record")
    ranked = new.withColumn("nth", F.row_number().over(w)).join(file.select(F.col("key").alias("fk")).distinct(), F.col("key") == F.col("fk"), "left")
    told = ranked.withColumn("status", F.when(F.col("fk").isNull() & (F.col("nth") == 1), OK).otherwise(DUPLICATE))
    return file.select("key", "record").union(told.where(F.col("status") == OK).select("key", "record")), told.select("key", "record", "status")


def rewrite(file: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = new.groupBy("key").agg(F.max("record").alias("record"))
    told = n.join(file.select(F.col("key").alias("fk")), F.col("key") == F.col("fk"), "left").select("key", F.when(F.col("fk").isNull(), MISSING).otherwise(OK).alias("status"))
    changed = file.select("key", F.col("record").alias("old")).join(n, "key", "left")
    return changed.select("key", F.coalesce("record", "old").alias("record")), told


def delete(file: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = keys.select("key").distinct()
    told = k.join(file.select(F.col("key").alias("fk")).distinct(), F.col("key") == F.col("fk"), "left").select("key", F.when(F.col("fk").isNull(), MISSING).otherwise(OK).alias("status"))
    return file.select("key", "record").join(k, "key", "left_anti"), told


def read_relative(slots: DataFrame) -> DataFrame:
    """Active records of (slot, active, record), gaps skipped, with the next active slot."""
    return slots.where("active").select("slot", "record")


def _slots(slots: DataFrame, new: DataFrame) -> DataFrame:
    n = new.groupBy("slot").agg(F.min("record").alias("new")).select(F.col("slot").alias("ns"), "new")
    return slots.join(n, F.col("slot") == F.col("ns"), "full").withColumn("active", F.coalesce("active", F.lit(False)))


def write_slots(slots: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, told): records of ``new`` (slot, record) go into empty slots (00); a slot in use refuses (22)."""
    both = _slots(slots, new)
    free = F.col("ns").isNotNull() & ~F.col("active")
    told = both.where("ns is not null").select(F.col("ns").alias("slot"), F.when(F.col("active"), DUPLICATE).otherwise(OK).alias("status"))
    return both.select(F.coalesce("slot", "ns").alias("slot"), (F.col("active") | free).alias("active"), F.when(free, F.col("new")).otherwise(F.col("record")).alias("record")), told


def rewrite_slots(slots: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, told): records of slots in use are replaced (00); an empty slot has none (23)."""
    both = _slots(slots, new)
    used = F.col("ns").isNotNull() & F.col("active")
    told = both.where("ns is not null").select(F.col("ns").alias("slot"), F.when(F.col("active"), OK).otherwise(MISSING).alias("status"))
    return both.where("slot is not null").select("slot", "active", F.when(used, F.col("new")).otherwise(F.col("record")).alias("record")), told


def delete_slots(slots: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, told): slots in use become empty (00); an empty one has no record (23)."""
    both = _slots(slots, gone.select("slot", F.lit("").alias("record")))
    told = both.where("ns is not null").select(F.col("ns").alias("slot"), F.when(F.col("active"), OK).otherwise(MISSING).alias("status"))
    return both.where("slot is not null").select("slot", (F.col("active") & F.col("ns").isNull()).alias("active"), "record"), told


def start_slot(slots: DataFrame, slot, how: str = ">=") -> DataFrame:
    """The slot in use at which reading goes on."""
    return start(read_relative(slots).withColumnRenamed("slot", "key"), slot, how).withColumnRenamed("key", "slot")


def read_alternate(file: DataFrame, offset: int, size: int, requests: DataFrame) -> DataFrame:
    """Each request (key) with the first record, in the file's own order, that has the key at ``offset``, and status 00 or 23."""
    alt = file.select(key_of("record", offset, size).alias("alt"), "key", "record").groupBy("alt").agg(F.min_by("record", "key").alias("record"))
    return requests.join(alt, requests.key == alt.alt, "left").select(requests.key, "record", F.when(F.col("alt").isNull(), MISSING).otherwise(OK).alias("status"))


def operations(organization: str) -> dict:
    """The operations by which a file of an organization is reached: indexed, relative, else sequential."""
    kinds = {
        "INDEXED": {"read": read_key, "start": start, "write": insert, "rewrite": rewrite, "delete": delete, "next": neighbours},
        "RELATIVE": {"read": read_relative, "start": start_slot, "write": write_slots, "rewrite": rewrite_slots, "delete": delete_slots},
    }
    return kinds.get(organization.upper(), {"read": read_sequential, "write": append, "rewrite": rewrite_last})


def access(mode: Column, op: Column) -> Column:
    """Status of an operation in a file's open mode."""
    reads, writes = op.isin("READ", "START"), op.isin("WRITE")
    changes = op.isin("REWRITE", "DELETE")
    return F.when(reads & ~mode.isin("INPUT", "I-O"), NOT_INPUT).when(writes & ~mode.isin("OUTPUT", "EXTEND", "I-O"), NOT_OUTPUT).when(changes & (mode != "I-O"), "49").otherwise(OK)
