"""Registered queries over record files that are written, changed and read back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import variable_layout
from sparkloom.functions.variable_layout import Depending, Renames
from sparkloom.plans.fixpoint import checkpointed, shared_dir
from sparkloom.plans.record_queries import table
from sparkloom.sources import sequential
from sparkloom.sources.indexed import IndexedFile

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


SIZE = 40
LAST = b"999999999999000000000001 the last one"
_ORDER_RECORDS = "lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 12, '0') || o_orderstatus AS record"


def _order_records(spark, sf) -> DataFrame:
    digits = lambda c: F.lpad(c.cast("string"), 12, "0")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.concat(digits(F.col("o_orderkey")), digits(cents), "o_orderstatus").alias("record"))


@query("rs09_sequential_files", f"""WITH o AS (SELECT o_orderkey, o_orderstatus, {_ORDER_RECORDS} FROM orders),
f AS (SELECT record, row_number() OVER (ORDER BY part, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM (SELECT 0 AS part, * FROM o UNION ALL SELECT 1, * FROM o WHERE o_orderstatus = 'F')),
g AS (SELECT place, CASE WHEN place = n - 1 THEN '{LAST.decode()}' ELSE record END AS record FROM f)
SELECT place, substr(record, 1, 12) AS key, CAST(substr(record, 13, 12) AS BIGINT) AS cents, rtrim(substr(record, 25, 16)) AS rest FROM g""")
def sequential_files(spark, sf) -> DataFrame:
    """Orders written in their order, those with status F appended, the last record rewritten; read back by ranges that cut inside the parts."""
    path = f"{shared_dir(spark).rstrip('/')}/sequential-{uuid.uuid4().hex}"
    o = checkpointed(_order_records(spark, sf))
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    sequential.write(o.repartitionByRange(n, "o_orderkey").sortWithinPartitions("o_orderkey"), path, SIZE)
    sequential.write(o.where("o_orderstatus = 'F'").repartitionByRange(n, "o_orderkey").sortWithinPartitions("o_orderkey"), path, SIZE, "append")
    sequential.rewrite_last(spark, path, SIZE, LAST)
    back = sequential.numbered(sequential.read(spark, path, SIZE, {"key": (0, 12), "cents": (12, 12), "rest": (24, 16)}, split=SIZE * 1000))
    text = lambda c: F.col(c).cast("string")
    return back.select(F.col("at").alias("place"), text("key").alias("key"), text("cents").cast("long").alias("cents"), F.rtrim(text("rest")).alias("rest"))


_CUSTOMERS = "c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key, c_name AS record, c_custkey AS k FROM customer)"
_CHANGED = f"""{_CUSTOMERS}, base AS (SELECT key, record FROM c WHERE k % 3 <> 0),
ins AS (SELECT key, record || ' new' AS record, CASE WHEN k % 3 <> 0 THEN '22' ELSE '00' END AS status FROM c WHERE k % 2 = 0),
one AS (SELECT key, record FROM base UNION ALL SELECT key, record FROM ins WHERE status = '00'),
rew AS (SELECT c.key, c.record || ' again' AS record, CASE WHEN one.key IS NULL THEN '23' ELSE '00' END AS status FROM c LEFT JOIN one ON one.key = c.key WHERE k % 5 = 0),
two AS (SELECT one.key, coalesce(rew.record, one.record) AS record FROM one LEFT JOIN rew ON rew.key = one.key),
del AS (SELECT c.key, CASE WHEN two.key IS NULL THEN '23' ELSE '00' END AS status FROM c LEFT JOIN two ON two.key = c.key WHERE k % 7 < 3),
three AS (SELECT two.key, two.record FROM two WHERE key NOT IN (SELECT key FROM del))"""


def _customer_file(spark, sf) -> tuple[IndexedFile, DataFrame]:
    """(file, statuses): two thirds of the customers, then every second one inserted, every fifth rewritten, three of seven deleted."""
    k = F.col("c_custkey")
    c = checkpointed(table(spark, sf, "customer").select(F.lpad(k.cast("string"), 10, "0").alias("key"), F.col("c_name").alias("record"), k.alias("k")))
    file = IndexedFile.create(c.where("k % 3 <> 0"), block_rows=200)
    told = file.insert(c.where("k % 2 = 0").select("key", F.concat("record", F.lit(" new")).alias("record"))).select(F.lit("insert").alias("verb"), "key", "status")
    told = told.union(file.rewrite(c.where("k % 5 = 0").select("key", F.concat("record", F.lit(" again")).alias("record"))).select(F.lit("rewrite"), "key", "status"))
    return file, told.union(file.delete(c.where("k % 7 < 3").select("key")).select(F.lit("delete"), "key", "status"))


@query("rs10_indexed_changes", f"WITH {_CHANGED} SELECT 'insert' AS verb, key, status FROM ins UNION ALL SELECT 'rewrite', key, status FROM rew UNION ALL SELECT 'delete', key, status FROM del")
def indexed_changes(spark, sf) -> DataFrame:
    """The status of every change of an indexed file of customers."""
    return _customer_file(spark, sf)[1]


@query("rs10_indexed_runs", f"WITH {_CHANGED} SELECT key, record FROM three")
def indexed_runs(spark, sf) -> DataFrame:
    """The file after its changes, as its base and runs give it."""
    return _customer_file(spark, sf)[0].scan()


@query("rs10_indexed_reads", f"WITH {_CHANGED} SELECT c.key, three.record, CASE WHEN three.key IS NULL THEN '23' ELSE '00' END AS status FROM c LEFT JOIN three ON three.key = c.key")
def indexed_reads(spark, sf) -> DataFrame:
    """Every customer asked for by key, after the changes and a compaction."""
    keys = table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("key"))
    return _customer_file(spark, sf)[0].compact().read(keys)


#: An order with its items, each with notes, and what comes behind the notes: places depend on two counters.
ORDER = (
    ("orderkey", 10), ("cents", 12), ("n_items", 2),
    Depending("items", "n_items", 99, (("partkey", 8), ("n_notes", 1), Depending("notes", "n_notes", 9, (("note", 5),)), ("quantity", 4))),
    ("status", 1), Renames("head", "orderkey", "cents"),
)


@query("re10_depending_tables", """WITH i AS (
  SELECT l_orderkey, l_partkey, l_linenumber % 3 AS nn, CAST(l_quantity AS BIGINT) AS q, row_number() OVER w AS nth, coalesce(sum(8 + 1 + 5 * (l_linenumber % 3) + 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 24 AS place
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)
) SELECT o_orderkey AS orderkey, o_orderstatus AS status, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 12, '0') AS head, CAST(nth AS INT) AS nth, CAST(place AS INT) AS place, l_partkey AS partkey, q AS quantity,
  CASE nn WHEN 0 THEN '' WHEN 1 THEN 'n' || nth || '-1' ELSE 'n' || nth || '-1,n' || nth || '-2' END AS notes
FROM orders JOIN i ON l_orderkey = o_orderkey""")
def depending_tables(spark, sf) -> DataFrame:
    """Orders and their items written as one record each, with tables in tables, and parsed back."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    i = table(spark, sf, "lineitem").withColumn("nth", F.row_number().over(line))
    note = lambda k: F.struct(F.concat(F.lit("n"), F.col("nth").cast("string"), F.lit("-"), k.cast("string")).alias("note"))
    notes = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda k: k <= F.col("l_linenumber") % 3), note)
    i = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("l_partkey").alias("partkey"), notes.alias("notes"), F.col("l_quantity").cast("long").alias("quantity")))).alias("items"))
    o = table(spark, sf, "orders").join(i, F.col("l_orderkey") == F.col("o_orderkey"))
    given = {"orderkey": F.col("o_orderkey"), "cents": F.round(F.col("o_totalprice") * 100).cast("long"), "items": F.col("items"), "status": F.col("o_orderstatus")}
    record = variable_layout.write(ORDER, given.__getitem__, frozenset(("orderkey", "cents", "partkey", "quantity")))
    path = f"{shared_dir(spark).rstrip('/')}/depending-{uuid.uuid4().hex}"
    o.select(record.alias("value")).write.text(path)
    read = spark.read.text(path).select(*[v.alias(k) for k, v in variable_layout.parse(F.col("value"), ORDER).items()])
    read = read.select("orderkey", "status", "head", F.posexplode("items").alias("nth", "item"))
    noted = F.array_join(F.transform("item.notes", lambda x: F.rtrim(x["note"])), ",")
    return read.select(
        F.col("orderkey").cast("long").alias("orderkey"), "status", "head", (F.col("nth") + 1).alias("nth"), F.col("item.items_at").alias("place"), F.col("item.partkey").cast("long").alias("partkey"),
        F.col("item.quantity").cast("long").alias("quantity"), noted.alias("notes"),
    )
