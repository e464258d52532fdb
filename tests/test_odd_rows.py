"""Registered queries on rows that the generated tables lack (large keys, nulls, repeated keys), against their SQL."""

import json

import numpy as np
import oracle
import pytest

from sparkloom.frontends.python_ast import lower
from sparkloom.plans import fixpoint, language_queries, registry
from sparkloom.vm import tables
from sparkloom.vm.columns import Columns
from sparkloom.vm.machine import Machine


def check(spark, tmp_path, query, name, schema, rows):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = con.execute(registry.ORACLES[query])
    names = [d[0] for d in got.description]
    df = registry.QUERIES[query](spark, str(tmp_path))
    assert sorted(df.columns) == sorted(names)
    have, want = oracle.multiset(df.columns, [tuple(r) for r in df.collect()]), oracle.multiset(names, got.fetchall())
    assert have == want
    return df


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"


def test_statistics_of_large_keys(spark, tmp_path):
    rows = [(k, 59_000 + 371 * k, 62_252 - 17 * k, k % 7 + 1, float(k % 50 + 1)) for k in range(400)]
    check(spark, tmp_path, "rc53_statistics", "lineitem", LINES, rows)


def test_statistics_of_missing_values(spark, tmp_path):
    rows = [(k, None if k & 1 else -7 * k, None if k & 2 else k, None if k & 4 else k % 7, None if k & 8 else k / 4) for k in range(64)]
    check(spark, tmp_path, "rc53_statistics", "lineitem", LINES, rows)


def test_spans_without_a_beginning(spark, tmp_path):
    rows = [(None if k % 5 == 0 else 37 * k - 600, None if k % 11 == 0 else k % 4) for k in range(200)] + [(None, 9), (None, 9), (3, 10)]
    check(spark, tmp_path, "rs16_merge_spans", "events", "event_id long, user_id long", rows)


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that a fixpoint writes."""
    seen = []
    for name in ("settled", "checkpointed"):

        def noted(df, write=getattr(fixpoint, name)):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df)

        monkeypatch.setattr(fixpoint, name, noted)
    return seen


def test_levels_broadcast_nothing(spark, tmp_path, plans):
    """Half of all nodes of a graph of any size are in the last levels: they must not pass through the driver."""
    df = check(spark, tmp_path, "rg15_topological_levels", "part", "p_partkey long", [(k,) for k in range(300)])
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 9 and not any("Broadcast" in p for p in plans)


def test_levels_of_loops_and_foreign_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("l",), ("on",), (None,)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("l", "l"), ("on", "l"), ("c", "foreign"), ("foreign", "a"), (None, "a"), ("c", None)], "src string, dst string")
    assert sorted(map(tuple, fixpoint.levels(nodes, edges).collect()), key=str) == [("a", 2), ("b", 1), ("c", 0), ("l", 3), ("on", 3), (None, 0)]


def test_branches_over_missing_and_repeated_keys(spark, tmp_path):
    keys = [None, None, 2**60 + 26, *range(120), *range(40)]
    check(spark, tmp_path, "rv18_branches_over_rows", "orders", "o_orderkey long", [(k,) for k in keys])


PROGRAMS = [
    "answer = x // y",
    "answer = x > y and x or not y",
    "answer = -x % y\nif answer > 3:\n  answer = answer * x * x * x",
    "while x < y:\n  x += 1\n  if x == 7: break\n  if x == 5: continue\n  k = x\nanswer = x",
    "if x > 2:\n  q = 1\nanswer = q + 1",
    "answer = 'a'\nif x > 3: answer = (x & y) + (x > 1)",
    "def f(a): return a + 1\nanswer = f(x)",
    "while x > 0:\n  x = x + 1\nanswer = z",
]


@pytest.mark.parametrize("source", PROGRAMS)
def test_runs_as_columns_equal_the_machine(source):
    code = lower(source)
    x = np.array([*range(-9, 30), 2**31, 2**61, 2**63 - 1, -(2**63)] * 5)
    y = np.arange(len(x)) % 11 - 3
    for most in (9, 40, 300):
        runs = Columns(code, {"x": x, "y": y}, len(x)).run(most)
        answers = runs.answers("answer")
        for k in np.flatnonzero(~runs.left):
            m = Machine(code, {"x": int(x[k]), "y": int(y[k])}).run(most)
            assert (answers[k], runs.finished[k]) == (json.dumps(m.plain(m.frames[0].vars.get("answer"))) if m.done else None, m.done)


def test_long_runs_stay_in_columns():
    """The rows of the registered loop are run together, none by a machine of its own."""
    runs = Columns(lower(language_queries._COLLATZ), {"x": np.arange(20_000)}, 20_000).run(20_000)
    assert runs.finished.all() and not runs.left.any() and runs.answers("answer")[26] == "111"


def test_runs_over_rows_in_both_ways(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else k, bool(k % 2), f"t{k}") for k in range(40)], "id int, x long, b boolean, t string")
    source = "answer = 1\nif b: answer = x * 4611686018427387904 if x is not None else 0"
    got = tables.run_over(rows, source, ["x", "b"], "answer").collect()
    assert {r["id"]: (r["x"], r["t"]) for r in got} == {k: (None if k % 5 == 0 else k, f"t{k}") for k in range(40)} and all(r["finished"] for r in got)
    assert all(r["answer"] == (str(r["x"] * 2**62) if r["x"] is not None and r["b"] else "0" if r["b"] else "1") for r in got)


def test_method_resolution_broadcasts_nothing(spark, tmp_path, plans):
    df = check(spark, tmp_path, "rg18_method_resolution", "part", "p_partkey long", [(k,) for k in [*range(-3, 200), 7, None]])
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
    spark.createDataFrame([(0,)], "p_partkey long").write.parquet(f"{tmp_path}/none/part.parquet")
    assert registry.QUERIES["rg18_method_resolution"](spark, f"{tmp_path}/none").collect() == []
