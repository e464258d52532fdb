"""Programs too big for one task go by rounds of joins and give the same rows; derived programs of any size."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cfg, dataflow
from sparkloom.plans import derived, fixpoint


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("bound", [0, 40])
def test_rounds_equal_tasks(spark, monkeypatch, bound):
    rng = random.Random(bound)
    edges = spark.createDataFrame(sorted({(p, f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for p in range(4) for _ in range(12 * (p + 1))}), "program_id bigint, src string, dst string")
    seeds = edges.groupBy("program_id").agg(F.min("src").alias("node"))
    facts = spark.createDataFrame(sorted({(p, f"n{rng.randrange(20)}", f"v{rng.randrange(3)}", 0) for p in range(4) for _ in range(25)}), "program_id bigint, block string, var string, idx int")
    flow = spark.createDataFrame(sorted({(p, f"%{rng.randrange(30)}", rng.choice((f"%{rng.randrange(30)}", f"v{rng.randrange(4)}"))) for p in range(4) for _ in range(20 * (p + 1))}), "program_id bigint, var string, source string")

    def every():
        return [rows(fixpoint.closure_by_key(edges, "program_id")), rows(fixpoint.reach_by_key(edges, seeds, "program_id")), rows(fixpoint.components_by_key(edges, "program_id")), rows(dataflow.reaching(facts, edges)), rows(dataflow.named_sources(flow))]

    want = every()
    monkeypatch.setattr(fixpoint, "GROUP_ROWS", bound)
    assert every() == want and all(want)


def test_one_large_program(spark, tmp_path):
    """200,000 events of one user: one block in three, no cell or group that grows with the square of them."""
    n = 200_000
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "purchase", "click", "signup", "error")]), (F.pmod(F.xxhash64("id"), F.lit(6)) + 1).cast("int"))
    ev = spark.range(n).select(F.col("id").alias("event_id"), (F.lit(datetime.datetime(2024, 1, 1)) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp").alias("ts"), F.lit(7).cast("bigint").alias("user_id"), kinds.alias("event_type"), F.concat(F.lit('{"k": '), F.col("id") % 1000, F.lit("}")).alias("props"))
    ev.write.parquet(f"{tmp_path}/events.parquet")
    p = fixpoint.checkpointed(cfg.placed(derived.instr(spark, str(tmp_path))))
    b = fixpoint.checkpointed(cfg.blocks(p))
    e = cfg.edges(b)
    assert p.count() == n and b.count() > n / 5
    ends = b.where("last_op = 'BRANCH'").count()
    assert e.join(b.where("last_op = 'BRANCH'").select("program_id", F.col("label").alias("src")), ["program_id", "src"]).count() == ends
    assert fixpoint.reach_by_key(e, b.where("block_ord = 0").select("program_id", F.col("label").alias("node")), "program_id").count() > 0
