"""Call trees against all paths found by plain recursion."""

from sparkloom.operators import interproc
from sparkloom.plans import program_queries as P
from sparkloom.plans.registry import QUERIES


def brute_trees(edges, root):
    def walk(path):
        yield " > ".join(path), len(path) - 1, path[-1] in path[:-1]
        if path[-1] not in path[:-1]:
            for s, d in sorted(set(edges)):
                if s == path[-1]:
                    yield from walk([*path, d])

    return set(walk([root]))


def test_call_trees_of_any_depth(spark):
    chain = [(f"f{i}", f"f{i + 1}") for i in range(60)] + [("f60", "f3"), ("f7", "f7"), ("f2", "f9"), ("g", "f59")]
    edges = spark.createDataFrame([(1, s, d) for s, d in chain] + [(2, "x", "y")], "program_id bigint, src string, dst string")
    roots = spark.createDataFrame([(1, "f0"), (1, "g"), (1, "g"), (3, "alone")], "program_id bigint, node string")
    rows = interproc.call_trees(edges, roots).collect()
    assert len(rows) == len(set(rows))
    want = {(1, r, *t) for r in ("f0", "g") for t in brute_trees(chain, r)} | {(3, "alone", "alone", 0, False)}
    assert {(r.program_id, r.root, r.path, r.depth, r.recursive) for r in rows} == want
    assert max(r.depth for r in rows) > 50


def test_call_trees_have_every_top_level_call(spark, sf):
    funcs, sites = P._sites(spark, sf)
    sites = sites.collect()
    edges: dict = {}
    for s in sites:
        if s.caller is not None and s.callee is not None:
            edges.setdefault(s.program_id, []).append((s.caller, s.callee))
    roots = [(s.program_id, s.block, s.idx, s.callee) for s in sites if s.caller is None and s.callee is not None]
    assert roots
    roots += [(f.program_id, None, None, f.label) for f in funcs.where("num = 0").collect()]
    want = sorted((str((p, b, i, *t)) for p, b, i, f in roots for t in brute_trees(edges.get(p, []), f)))
    assert sorted(str(tuple(r)) for r in QUERIES["ri25_call_trees"](spark, sf).collect()) == want
