"""Condensation, jump tables, type flow and record files against plain versions on small inputs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import type_flow
from sparkloom.operators.components import condensation, strong_components
from sparkloom.operators.lineage import JumpTable
from sparkloom.plans import fixpoint, graph_queries
from sparkloom.sources import sequential
from sparkloom.sources.indexed import IndexedFile


def plain_condensation(nodes, edges):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    component = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    between = {(component[a], component[b]) for a, b in edges if component[a] != component[b]}
    rank = dict.fromkeys(component.values(), 0)
    for _ in nodes:
        for a, b in between:
            rank[a] = max(rank[a], rank[b] + 1)
    return {(n, component[n], rank[component[n]]) for n in nodes}


def test_condensation(spark):
    random.seed(4)
    edges = [(a, a + 1) for a in range(12)] + [(12, 9), (3, 1), (3, 1), (20, 20), (21, 22)]  # a tail, two circles, a loop, a repeated edge
    edges += [(30 + random.randrange(25), 30 + random.randrange(25)) for _ in range(40)]
    nodes = sorted({x for e in edges for x in e} | {99})
    n, e = spark.createDataFrame([(x,) for x in [*nodes, None]], "node int"), spark.createDataFrame([*edges, (None, 1), (2, None)], "src int, dst int")
    assert {tuple(r) for r in condensation(n, e).collect()} == plain_condensation(nodes, edges)
    assert strong_components(n.limit(0), e.limit(0)).collect() == []


def test_jump_tables(spark):
    random.seed(2)
    parents = {1: None, 2: None} | {k: random.choice([k - 1, k - 2, k // 2]) for k in range(3, 60)} | {100: 200}
    table = spark.createDataFrame([*parents.items(), (3, parents[3])], "node long, parent long")

    def line(x):
        out = [x]
        while parents.get(out[-1]) is not None:
            out.append(parents[out[-1]])
        return out

    asked = [(random.choice([*parents]), random.choice([*parents])) for _ in range(150)] + [(7, 7), (100, 200), (100, 1), (7, 7)]
    want = set()
    for a, b in asked:
        common = [x for x in line(a) if x in line(b)]
        want.add((a, b, b in line(a), common[0] if common else None))
    jump = JumpTable(table)
    assert len(jump.steps) <= 7 and {tuple(r) for r in jump.depth.collect()} == {(x, len(line(x)) - 1) for x in [*parents, 200]}
    rows = jump.bounds(spark.createDataFrame([*asked, (None, 1)], "a long, b long")).collect()
    assert len(rows) == len(want) and set(map(tuple, rows)) == want
    with pytest.raises(ValueError, match="circle"):
        JumpTable(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "node long, parent long"))


def plain_types(rows, seeds):
    """A loop over one program's instructions until nothing grows."""
    types, names = {}, set()
    for op, reg, ops in rows:
        names |= {ops[0]} if op in ("LOAD_VAR", "STORE_VAR", "DECL_VAR", "STORE_INDEX", "LOAD_INDEX") and ops else set()
    for n in names & set(seeds):
        types[n] = type_flow.mask_of(seeds[n])
    while True:
        before = dict(types)

        def put(name, mask):
            if name is not None and mask:
                types[name] = types.get(name, 0) | mask

        get = lambda n: types.get(n, 0)
        for op, reg, ops in rows:
            a, b, c = (*ops, None, None, None)[:3]
            if op == "CONST":
                put(reg, {"1": type_flow.INT, "2.5": type_flow.FLOAT, "x y": type_flow.STRING, "True": type_flow.BOOL}[a])
            elif op in ("LOAD_VAR", "STORE_VAR"):
                s, d = (a, reg) if op == "LOAD_VAR" else (b, a)
                if s is not None and d is not None:
                    put(d, get(s))
                    put(f"{d}[]", get(f"{s}[]"))
                    put(f"{s}[]", get(f"{d}[]"))
            elif op == "STORE_INDEX":
                put(a, type_flow.MASKS["Array"])
                if c is not None:
                    put(f"{a}[]", get(c))
            elif op == "LOAD_INDEX":
                put(reg, get(f"{a}[]"))
            elif op == "NEW_ARRAY":
                put(reg, type_flow.MASKS["Array"])
            elif op == "BINOP" and len(ops) == 3:
                put(reg, type_flow.binop_mask(a, get(b), get(c)))
        if types == before:
            return types


LATTICE = {"Int", "Float", "Number", "String", "Bool", "Array", "Object", "Any"}


def named(types):
    def name(mask):
        return min((t for t, m in type_flow.MASKS.items() if not mask & ~m), key=lambda t: (type_flow.MASKS[t].bit_count(), type_flow.MASKS[t]))

    return {(n, name(m), name(types[f"{n}[]"]) if f"{n}[]" in types else None) for n, m in types.items() if not n.endswith("[]")}


@pytest.mark.parametrize("rows_in_a_task", [1_000_000, 0])
def test_type_flow(spark, monkeypatch, rows_in_a_task):
    monkeypatch.setattr(fixpoint, "GROUP_ROWS", rows_in_a_task)
    code = [
        ("CONST", "r0", ["1"]), ("CONST", "r1", ["2.5"]), ("CONST", "r2", ["x y"]), ("CONST", "r3", ["True"]), ("STORE_VAR", None, ["a", "r0"]), ("STORE_VAR", None, ["a", "r1"]),
        ("LOAD_VAR", "r4", ["a"]), ("BINOP", "r5", ["+", "r4", "r0"]), ("BINOP", "r6", ["+", "r5", "r2"]), ("BINOP", "r7", ["<", "q", "r2"]), ("BINOP", "r8", ["-", "r3", "r0"]),
        ("NEW_ARRAY", "r9", ["list", "r0"]), ("STORE_VAR", None, ["xs", "r9"]), ("STORE_VAR", None, ["ys", "r9"]), ("STORE_INDEX", None, ["xs", "r0", "r0"]), ("STORE_INDEX", None, ["ys", "r0", "r8"]),
        ("LOAD_INDEX", "r10", ["r9", "r0"]), ("STORE_INDEX", None, ["zs", "r0", "r6"]), ("STORE_INDEX", None, ["zs", "r0", "r9"]), ("LOAD_INDEX", "r11", ["zs", "r0"]), ("STORE_VAR", None, ["a", "r11"]),
        ("STORE_VAR", None, ["lone"]), ("BINOP", "r12", ["+", "r12", "r0"]), ("BINOP", "r13", ["+", "seeded", "r1"]), ("LOAD_VAR", "r14", ["seeded"]), ("LOAD_VAR", None, [None]),
    ]
    table = spark.createDataFrame([(p, k, op, reg, ops) for p in (1, 2) for k, (op, reg, ops) in enumerate(code[: len(code) // p])], "program_id bigint, pc int, opcode string, result_reg string, operands array<string>")
    out = type_flow.infer(table, {"seeded": "Int"}).collect()
    for p in (1, 2):
        assert {tuple(r)[1:] for r in out if r.program_id == p} == named(plain_types(code[: len(code) // p], {"seeded": "Int"}))
    assert type_flow.infer(table.limit(0), {}).collect() == []


def test_type_flow_of_programs(spark, sf, monkeypatch):
    programs = {}
    for r in graph_queries.array_programs(spark, sf).orderBy("program_id", "pc").collect():
        programs.setdefault(r.program_id, []).append((r.opcode, r.result_reg, r.operands))
    want = {(p, *x) for p, rows in programs.items() for x in named(plain_types(rows, graph_queries.VARIABLE_TYPES))}
    assert {tuple(r) for r in graph_queries.QUERIES["rt02_type_flow"](spark, sf).collect()} == want
    assert {"Int", "Float", "Number", "String", "Array", "Any"} <= {x[2] for x in want} and any(x[3] for x in want)


def test_sequential_files(spark, tmp_path):
    path = str(tmp_path / "f")
    assert sequential.read(spark, path, 8).collect() == []
    records = spark.range(1000, numPartitions=3).select(F.format_string("%05d", "id").alias("record"))
    sequential.write(records, path, 8)
    sequential.write(records.limit(5), path, 8, "append")
    back = sequential.numbered(sequential.read(spark, path, 8, split=8 * 64))
    assert [bytes(r.record) for r in back.orderBy("at").collect()] == [b"%05d   " % k for k in [*range(1000), *range(5)]]
    assert sequential.read(spark, path, 8, split=8 * 64).rdd.getNumPartitions() > 15
    sequential.rewrite_last(spark, path, 8, b"last")
    assert sorted(os.listdir(path)) == [f"part-{k:08d}" for k in range(4)]
    ends = sequential.read(spark, path, 8, {"a": (0, 2), "b": (2, 6)}).orderBy("part", "nth").collect()
    assert (ends[-1].a, ends[-1].b, ends[0].b) == (b"la", b"st    ", b"000   ")
    with open(f"{path}/part-00000004", "wb") as f:
        f.write(b"12345678abc")
    short = sequential.read(spark, path, 8, {"a": (0, 2), "b": (2, 6)}).where("part = 'part-00000004'").orderBy("nth").collect()
    assert [(r.a, r.b) for r in short] == [(b"12", b"345678"), (b"ab", b"c")]
    with pytest.raises(Exception, match="longer than"):
        sequential.write(spark.createDataFrame([("123456789",)], "record string"), path, 8, "append")
    assert sorted(os.listdir(path)) == [f"part-{k:08d}" for k in range(5)]  # nothing of the failed write is left
    sequential.write(records.limit(1), path, 8)
    assert sequential.read(spark, path, 8).count() == 1


def test_indexed_files(spark):
    key = F.format_string("k%04d", "id")
    file = IndexedFile.create(spark.range(0, 2000, 2).select(key.alias("key"), F.concat(F.lit("v"), "id").alias("record")), block_rows=100)
    assert len(file.lows) > 5
    told = file.insert(spark.createDataFrame([("k0001", "b"), ("k0001", "a"), ("k0002", "x"), ("zz", "end"), (None, "n")], "key string, record string")).collect()
    assert sorted((r.key or "", r.record, r.status) for r in told) == [("", "n", "23"), ("k0001", "a", "00"), ("k0001", "b", "22"), ("k0002", "x", "22"), ("zz", "end", "00")]
    rows = spark.createDataFrame([("k0004", "p"), ("k0004", "q"), ("k0005", "r")], "key string, record string")
    assert sorted(map(tuple, file.rewrite(rows).collect())) == [("k0004", "00"), ("k0005", "23")]
    assert sorted(map(tuple, file.delete(spark.range(10, 700).select(key.alias("key"))).where("status = '00'").collect())) == [(f"k{k:04d}", "00") for k in range(10, 700, 2)]
    for f in (file, file.compact()):
        assert f.read(spark.createDataFrame([("k0004",), ("k0012",), ("zz",)], "key string")).orderBy("key").collect() == [("k0004", "q", "00"), ("k0012", None, "23"), ("zz", "end", "00")]
        assert [r.key for r in f.start("k0008", ">", 2).collect()] == ["k0700", "k0702"]  # over blocks whose records are all gone
        assert [r.key for r in f.start("k0002").collect()] == ["k0002"] and f.start("k0003", "=").collect() == [] and f.start("zzz").collect() == []
        assert f.scan().count() == 1000 + 2 - 345
    assert len(file.runs) == 1
    plan = file._rows([2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "PartitionFilters: [block" in plan


def test_patches(spark):
    from sparkloom.operators import patching

    random.seed(8)
    texts = [(1, "abcdef" * 50), (2, ""), (3, None), (4, "é日本😀x" * 20), (None, "kept")]
    spans = [(i, (a := random.randrange(-1, 110)), a + random.randrange(-1, 6), random.choice(["", "X", "long word", None])) for i in (1, 4) for _ in range(40)]
    spans += [(1, 10, 10, "b"), (1, 10, 10, "a"), (1, 299, 300, "end"), (1, 300, 300, "!"), (2, 0, 0, "new"), (3, 0, 0, "x"), (9, 0, 0, "x"), (None, 0, 1, "x"), (1, None, 3, "x")]
    t, s = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(spans, "id int, start int, stop int, replacement string")
    want = {}
    for i, text in texts:
        out, shift, reach, kept, refused, own = text, 0, 0, 0, 0, [x for x in spans if x[0] == i and i is not None]
        fits = [x for x in own if text is not None and None not in x and 0 <= x[1] <= x[2] <= len(text)]
        for _, a, b, w in sorted(fits):
            if a < reach:
                refused += 1
            else:
                out = out[: a + shift] + w + out[b + shift :]
                shift += len(w) - (b - a)
                kept += 1
            reach = max(reach, b)
        want[i] = (out, kept, refused + len(own) - len(fits))
    assert {r.id: (r.text, r.kept, r.refused) for r in patching.patched(t, s).collect()} == want
    assert want[1][1] > 5 and want[4][2] > 5
    told = patching.judged(t, s).where("id = 1 and status = 'kept'").collect()
    assert all(want[1][0][r.new_start :].startswith(r.replacement) for r in told)


def test_running_totals_of_a_hot_group(spark):
    from sparkloom.operators.linking import running_totals

    rows = [(0 if k % 3 else k % 7, None if k % 50 == 0 else k // 2, k, k % 5) for k in range(600)]
    got = running_totals(spark.createDataFrame(rows, "g int, place int, k int, v int"), "g", ["place", "k"], {"before": "v"}).collect()
    sums, want = {}, {}
    for g, p, k, v in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        want[k] = sums.get(g, 0)
        sums[g] = want[k] + v
    assert {r.k: r.before for r in got} == want


def test_linked_names_and_places(spark):
    from sparkloom.operators import linking

    code = [
        (1, 0, "STORE_VAR", None, ["x", "%0"], "", []), (1, 1, "LOAD_VAR", "%3", ["y"], "", []), (1, 2, "BRANCH", None, [], "", ["__block_0"]),
        (2, 0, "LABEL", None, [], "L", []), (2, 1, "STORE_VAR", None, ["y", "%0"], "", []), (2, 2, "STORE_VAR", None, ["x", "%0"], "", []), (2, 3, "BRANCH_IF", None, ["*%1"], "", ["L", "__block_3"]),
        (3, 0, "LOAD_VAR", "%0", ["x"], "", []), (3, 1, "LOAD_VAR", "%1", ["z"], "", []), (4, 0, "LOAD_VAR", "%0", ["x"], "", []),
    ]
    c = spark.createDataFrame(code, "program_id bigint, pc int, opcode string, result_reg string, operands array<string>, label string, branch_targets array<string>")
    modules = spark.createDataFrame([(0, 2, 1), (0, 1, 2), (0, 3, 3), (7, 4, 1), (0, 99, 0)], "project int, program_id bigint, place int")
    exports = spark.createDataFrame([(1, "x"), (2, "y"), (2, "x"), (4, "x")], "program_id bigint, name string")
    rows = [(r.project, r.pc, r.label or r.result_reg, " ".join(r.operands), r.branch_targets) for r in linking.link_table(c, modules, exports).orderBy("project", "pc").collect()]
    assert rows == [
        (0, 0, "m2", "", []), (0, 1, "m2.L", "", []), (0, 2, None, "m2.y %0", []), (0, 3, None, "m2.x %0", []), (0, 4, None, "*%1", ["m2.L", "__block_4"]),
        (0, 5, "m1", "", []), (0, 6, None, "m1.x %0", []), (0, 7, "%3", "m2.y", []), (0, 8, None, "", ["m1"]),
        (0, 9, "m3", "", []), (0, 10, "%4", "m2.x", []), (0, 11, "%5", "z", []), (7, 0, "m4", "", []), (7, 1, "%0", "m4.x", []),
    ]


def test_depending_layouts(spark):
    from sparkloom.functions.variable_layout import Depending, Renames, parse

    layout = (("a", 2), ("n", 1), Depending("t", "n", 3, (("m", 1), Depending("u", "m", 9, (("x", 2),)), ("y", 1))), ("z", 3), Renames("az", "a", "n"), Renames("tz", "t", "z"))
    records = ["AA22x1x2Y0Wzzz", "BB0zzz", "CC", "", None, "DD?zzz", "EE92aabbq0r0szzz", "FF13aa"]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(records)], "k int, r string").select("k", *[c.alias(n) for n, c in parse(F.col("r"), layout).items()]).orderBy("k").collect()
    plain = [(r.a, [(t.t_at, t.m, [u.x for u in t.u], t.y) for t in r.t] if r.t is not None else None, r.z, r.az, r.tz) for r in rows]
    assert plain == [
        ("AA", [(3, "2", ["x1", "x2"], "Y"), (9, "0", [], "W")], "zzz", "AA2", "2x1x2Y0Wzzz"), ("BB", [], "zzz", "BB0", "zzz"), ("CC", [], "", "CC", ""), ("", [], "", "", ""), (None, None, None, None, None),
        ("DD", [], "zzz", "DD?", "zzz"), ("EE", [(3, "2", ["aa", "bb"], "q"), (9, "0", [], "r"), (11, "0", [], "s")], "zzz", "EE9", "2aabbq0r0szzz"), ("FF", [(3, "3", ["aa", "", ""], "")], "", "FF1", "3aa"),
    ]


def test_tries(spark):
    from sparkloom.operators import trie

    paths = [(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", "b"]), (4, []), (5, None), (6, ["b", None, "x"]), (7, ["b"]), (8, ["a", "", "c"]), (9, ["a"] * 30)]
    p = spark.createDataFrame(paths, "id int, path array<string>")
    nodes = fixpoint.checkpointed(trie.build(p))
    whole = [tuple(x) for _, x in paths if x is not None]
    every = {x[:k] for x in whole for k in range(len(x) + 1)}
    assert nodes.count() == len(every) == nodes.select("node").distinct().count()
    known = {tuple(r.path): r.node for r in trie.places(nodes, p).collect()}
    assert set(known) == set(whole) and known[()] == 0
    marked = [("a", "b"), ("b",), ("a",) * 30]
    m = spark.createDataFrame([(known[x],) for x in marked], "node long")
    asked = [*paths, (10, ["a", "x"]), (11, ["a", "b", "q", "r"]), (12, ["zz"]), (13, ["b", None])]
    name = {v: k for k, v in known.items()}
    got = {r.id: name.get(r.node) for r in trie.longest_prefix(nodes, m, spark.createDataFrame(asked, p.schema)).collect()}
    assert got == {i: max((x for x in marked if path is not None and tuple(path[: len(x)]) == x), key=len, default=None) for i, path in asked}
    near = {r.node: name.get(r.root) for r in trie.nearest_marked(nodes, m).collect()}
    assert {x: near[n] for x, n in known.items()} == {x: max((y for y in marked if x[: len(y)] == y), key=len, default=None) for x in whole}
    assert trie.build(p.limit(0)).collect() == [(0, None, 0, None)]
