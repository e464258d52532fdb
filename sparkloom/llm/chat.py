"""Chat formatting by multi-party perspective rotation.

Each conversation is rendered once for every participant: the participant's own turns as the assistant,
others' turns as users under their names, and turns of ``FIXED`` roles (system) as they are. The result
has a row for each turn of each rendering: its segment of the text, the place where it starts, and the
place of what is learnt from (``mask_start`` to ``mask_end``: the assistant's words and the end
mark; null for all other turns). Segments in the order of ``start`` make up the rendering, so no
conversation's text is ever gathered in one task, however long.

Texts move once, into sampled ranges of (conversation, turn); participants and running lengths are windows inside a
range. Of a range's conversations only the first can have begun in an earlier one: what it needs from
there, participants and lengths, comes from a table without texts of the conversations that span ranges,
broadcast up to ``BROADCAST_ROWS`` rows and joined by shuffle beyond.

Defined cases: turns are ordered by turn (null first), role, text; a null role is ``unknown``, a null text
empty; rows without conversation identifier are one conversation; repeated rows are turns of their
own; a conversation whose roles are all fixed has no participants and gives no row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import bucket_of, cut, sampled_splitters, shuffle_partitions

FIXED = ("system",)
END = "<|end|>\n"
BROADCAST_ROWS = 200_000


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", fixed: tuple[str, ...] = FIXED) -> DataFrame:
    """(conv_id, perspective, turn, role, segment, start, mask_start, mask_end), a row for each turn and participant."""
    spark = turns.sparkSession
    parts = shuffle_partitions(spark)
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    key = {"c": F.col("c"), "t": F.col("t")}
    schema = T.StructType([T.StructField("c", T.LongType()), T.StructField("t", T.LongType())])
    rows = rows.withColumn("b", bucket_of(sampled_splitters(rows, key, parts * 8), key, schema))
    person = F.when(~F.col("r").isin(*fixed), F.col("r"))
    own = F.col("r") == F.col("p")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("r").isin(*fixed), F.concat(F.lit("<|"), F.col("r"), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user|>\n"), F.col("r"), F.lit(": ")))

    # Conversations that span ranges: at most one a range goes on from an earlier one.
    total = cut(rows.groupBy("b", "c", "r").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("x")).alias("len")))
    spans = total.select("b", "c").distinct().groupBy(F.col("c").alias("sc")).agg(F.count(F.lit(1)).alias("ranges")).where("ranges > 1").select("sc")
    total = cut(total.join(F.broadcast(spans), F.col("c").eqNullSafe(F.col("sc"))).drop("sc"))
    people = total.groupBy("c").agg(F.collect_set(person).alias("people")).select(F.col("c").alias("pc"), "people", F.lit(True).alias("spans"))
    each = total.join(people, F.col("c").eqNullSafe(F.col("pc"))).select("b", "c", "r", "k", "len", F.explode("people").alias("p"))
    each = each.groupBy("b", "c", "p").agg(F.sum(F.col("len") + F.col("k") * (F.length(head) + len(END))).alias("all"))
    w = Window.partitionBy("c", "p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(each.select(F.col("b").alias("bb"), F.col("c").alias("bc"), F.col("p").alias("bp"), F.coalesce(F.sum("all").over(w), F.lit(0)).alias("before")))
    hint = F.broadcast if before.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df

    dealt = rows.repartition(parts, "b").withColumn("here", F.collect_set(person).over(Window.partitionBy("b", "c")))
    dealt = dealt.join(hint(people), F.col("c").eqNullSafe(F.col("pc")), "left")
    seen = dealt.select("b", "c", "t", "r", "x", F.explode(F.array_sort(F.when(F.col("spans"), F.col("people")).otherwise(F.col("here")))).alias("p"))
    seen = seen.select("b", "c", "t", "r", "p", "x", F.concat(head, "x", F.lit(END)).alias("segment"), F.length(head).alias("h"), own.alias("own")).withColumn("n", F.length("segment").cast("long"))
    w = Window.partitionBy("b", "c", "p").orderBy(F.col("t").asc_nulls_first(), "r", "x").rowsBetween(Window.unboundedPreceding, -1)
    out = seen.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("x")
    out = out.join(hint(before), (F.col("b") == F.col("bb")) & F.col("c").eqNullSafe(F.col("bc")) & (F.col("p") == F.col("bp")), "left").withColumn("start", F.col("start") + F.coalesce("before", F.lit(0)))
    return out.select(F.col("c").alias(conv_col), F.col("p").alias("perspective"), F.col("t").alias(turn_col), F.col("r").alias(role_col), "segment", "start", F.when(F.col("own"), F.col("start") + F.col("h")).alias("mask_start"), F.when(F.col("own"), F.col("start") + F.col("n")).alias("mask_end"))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS x FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role NOT IN ('system')),
s AS (
  SELECT t.conv_id, perspective, turn, role, x, CASE WHEN role = perspective THEN '<|assistant|>' || chr(10)
    WHEN role IN ('system') THEN '<|' || role || '|>' || chr(10) ELSE '<|user|>' || chr(10) || role || ': ' END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), g AS (
  SELECT *, head || x || '<|end|>' || chr(10) AS segment FROM s
), o AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g
)
SELECT conv_id, perspective, turn, role, segment, start,
  CASE WHEN role = perspective THEN start + length(head) END AS mask_start, CASE WHEN role = perspective THEN start + length(segment) END AS mask_end
FROM o
"""
