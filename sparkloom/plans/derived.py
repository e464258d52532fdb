"""A program for each user of ``events``, so that program analysis runs at any scale on the test tables.

The events of a user in time order are its instructions: signup LABEL, click LOAD_VAR, view BINOP of the
two registers written last, purchase STORE_VAR of the last one, error BRANCH_IF, BRANCH or RETURN by the event's
number; k of the properties picks variables and targets. One sort by (user, time) gives all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VARIABLES = 8


def instr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general instruction table (:data:`sparkloom.plans.schema.INSTR`) of the derived programs, plus event_id and k."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("program_id").orderBy("ts", "event_id")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    e = ev.select(F.col("user_id").alias("program_id"), "event_id", "ts", "event_type", F.regexp_extract("props", "(-?[0-9]+)", 1).cast("int").alias("k"))
    e = e.withColumn("pc", F.row_number().over(w) - 1)
    e = e.withColumn("result_reg", F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("%"), F.col("event_id").cast("string"))))
    e = e.withColumn("p1", F.last("result_reg", ignorenulls=True).over(back))
    e = e.withColumn("p2", F.last(F.when(F.col("result_reg").isNotNull(), F.col("p1")), ignorenulls=True).over(back))
    leader = (F.col("pc") == 0) | (F.col("event_type") == "signup") | (F.lag("event_type").over(w) == "error")
    e = e.withColumn("ord", F.sum(leader.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    e = e.withColumn("name", F.when(F.col("event_type") == "signup", F.concat(F.lit("L"), F.col("event_id").cast("string"))))
    # A branch names blocks by number: the label of the next one lies in the next row, that of any other is met by an equi-join.
    head = F.coalesce("name", F.concat(F.lit("__block_"), F.col("pc").cast("string")))
    e = e.withColumns({"following": F.lead(head).over(w), "blocks": F.max("ord").over(Window.partitionBy("program_id")) + 1, "head": F.when(leader, head)})
    kind = F.pmod("event_id", F.lit(4))
    opcode = (
        F.when(F.col("event_type") == "signup", "LABEL").when(F.col("event_type") == "click", "LOAD_VAR").when(F.col("event_type") == "view", "BINOP").when(F.col("event_type") == "purchase", "STORE_VAR")
        .when(kind % 2 == 0, "BRANCH_IF").when(kind == 1, "BRANCH").otherwise("RETURN")
    )
    var = F.concat(F.lit("v"), F.pmod("k", F.lit(VARIABLES)).cast("string"))
    e = e.withColumn("opcode", opcode)
    operands = (
        F.when(F.col("opcode") == "LOAD_VAR", F.array(var)).when(F.col("opcode") == "BINOP", F.array(F.lit("+"), F.col("p2"), F.col("p1")))
        .when(F.col("opcode") == "STORE_VAR", F.array(var, F.col("p1"))).otherwise(F.array().cast("array<string>"))
    )
    e = e.withColumn("operands", operands).withColumn("to", F.when(F.col("opcode").startswith("BRANCH"), F.pmod("k", F.col("blocks"))))
    heads = e.where("head is not null").select(F.col("program_id").alias("hp"), F.col("ord").alias("ho"), F.col("head").alias("jump"))
    # Rows that do not branch get a number of their own that no block has, so that they spread over all tasks.
    e = e.withColumn("to", F.coalesce("to", -1 - F.col("pc"))).join(heads, (F.col("program_id") == F.col("hp")) & (F.col("to") == F.col("ho")), "left")
    targets = F.when(F.col("opcode") == "BRANCH_IF", F.array("jump", "following")).when(F.col("opcode") == "BRANCH", F.array("jump")).otherwise(F.array().cast("array<string>"))
    keep = lambda c: F.filter(c, lambda x: x.isNotNull())
    return e.select("program_id", F.col("pc").cast("int").alias("pc"), "opcode", "result_reg", keep(F.col("operands")).alias("operands"), F.coalesce("name", F.lit("")).alias("label"), keep(targets).alias("branch_targets"), "event_id", "k")


#: The same on DuckDB: CTEs ev, ins (instructions with block), blk (blocks), edge, def, use, gen, fn (functions), own (blocks' owners), site (call sites).
SQL = r"""
ev AS (
  SELECT user_id AS program_id, event_id, event_type, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INT) AS k,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pc,
    CASE event_type WHEN 'signup' THEN 'LABEL' WHEN 'click' THEN 'LOAD_VAR' WHEN 'view' THEN 'BINOP' WHEN 'purchase' THEN 'STORE_VAR'
      ELSE CASE event_id % 4 WHEN 1 THEN 'BRANCH' WHEN 3 THEN 'RETURN' ELSE 'BRANCH_IF' END END AS opcode
  FROM events
), wr AS (
  SELECT program_id, pc, '%' || event_id AS reg, row_number() OVER (PARTITION BY program_id ORDER BY pc) AS w FROM ev WHERE event_type IN ('click', 'view')
), e1 AS (
  SELECT ev.*, CASE WHEN event_type IN ('click', 'view') THEN '%' || event_id END AS result_reg, 'v' || (k % 8) AS var,
    count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) OVER (PARTITION BY program_id ORDER BY pc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wb,
    pc = 0 OR event_type = 'signup' OR coalesce(lag(event_type) OVER (PARTITION BY program_id ORDER BY pc) = 'error', FALSE) AS leader
  FROM ev
), e2 AS (
  SELECT e1.*, a.reg AS p1, b.reg AS p2, CAST(sum(CAST(leader AS INT)) OVER (PARTITION BY e1.program_id ORDER BY e1.pc) - 1 AS INT) AS ord
  FROM e1 LEFT JOIN wr a ON a.program_id = e1.program_id AND a.w = e1.wb LEFT JOIN wr b ON b.program_id = e1.program_id AND b.w = e1.wb - 1
), blk AS (
  SELECT program_id, ord AS block_ord, CASE WHEN arg_min(event_type, pc) = 'signup' THEN 'L' || arg_min(event_id, pc) ELSE '__block_' || min(pc) END AS label,
    min(pc) AS first_pc, arg_max(opcode, pc) AS last_op, arg_max(k, pc) AS last_k, arg_min(event_type, pc) = 'signup' AS is_func, arg_min(event_id, pc) AS first_event,
    CAST(count(*) FILTER (event_type <> 'signup') AS INT) AS n_instr
  FROM e2 GROUP BY program_id, ord
), ins AS (
  SELECT e2.*, blk.label AS block, CAST(e2.pc - blk.first_pc - CAST(blk.is_func AS INT) AS INT) AS idx FROM e2 JOIN blk ON blk.program_id = e2.program_id AND blk.block_ord = e2.ord
), cnt AS (SELECT program_id, count(*) AS n FROM blk GROUP BY program_id),
edge AS (
  SELECT DISTINCT b.program_id, b.label AS src, t.label AS dst FROM blk b JOIN cnt USING (program_id) JOIN blk t ON t.program_id = b.program_id
    AND ((b.last_op IN ('BRANCH', 'BRANCH_IF') AND t.block_ord = b.last_k % cnt.n) OR (b.last_op NOT IN ('BRANCH', 'RETURN') AND t.block_ord = b.block_ord + 1))
), def AS (
  SELECT program_id, block, idx, result_reg AS var FROM ins WHERE opcode IN ('LOAD_VAR', 'BINOP') UNION ALL SELECT program_id, block, idx, var FROM ins WHERE opcode = 'STORE_VAR'
), use AS (
  SELECT program_id, block, idx, var FROM ins WHERE opcode = 'LOAD_VAR' UNION ALL SELECT program_id, block, idx, p2 FROM ins WHERE opcode = 'BINOP' AND p2 IS NOT NULL
  UNION ALL SELECT program_id, block, idx, p1 FROM ins WHERE opcode IN ('BINOP', 'STORE_VAR') AND p1 IS NOT NULL
), gen AS (SELECT program_id, block, var, max(idx) AS idx FROM def GROUP BY program_id, block, var),
fn AS (SELECT program_id, label, first_event, CAST(row_number() OVER (PARTITION BY program_id ORDER BY block_ord) - 1 AS INT) AS num FROM blk WHERE is_func),
own AS (SELECT program_id, label, block_ord, last_value(CASE WHEN is_func THEN label END IGNORE NULLS) OVER (PARTITION BY program_id ORDER BY block_ord) AS func FROM blk),
nf AS (SELECT program_id, count(*) AS n FROM fn GROUP BY program_id),
site AS (
  SELECT i.program_id, own.func AS caller, i.block, i.idx, fn.label AS callee FROM ins i JOIN own ON own.program_id = i.program_id AND own.label = i.block
    JOIN nf ON nf.program_id = i.program_id JOIN fn ON fn.program_id = i.program_id AND fn.num = i.k % nf.n
  WHERE i.opcode = 'LOAD_VAR' AND i.k % 5 = 0 AND own.func IS NOT NULL
)
"""


def oracle(select: str, recursive: str = "") -> str:
    return "WITH RECURSIVE " + SQL + (", " + recursive if recursive else "") + select
