"""Calls and parameters of any length."""

from sparkloom.operators import cfg, registry
from sparkloom.plans.schema import INSTR


def test_all_arguments_and_whole_names(spark):
    args = [f"%{i}" for i in range(1200)]
    names = ["p" * 300 + "a", "p" * 300 + "b"]
    code = [("LABEL", [], "func_f_0")] + [("SYMBOLIC", [f"param:{n}"], None) for n in names]
    code += [("CALL_FUNCTION", ["f", *args], None), ("CALL_METHOD", ["o", "m", *args], None), ("CALL_FUNCTION", ["f"], None), ("CALL_METHOD", ["o", "m"], None)]
    p = cfg.placed(spark.createDataFrame([(1, pc, op, None if op == "LABEL" else f"%r{pc}", o, label, []) for pc, (op, o, label) in enumerate(code)], INSTR))
    assert [r.param for r in registry.parameters(p).orderBy("pos").collect()] == names
    assert [r.args for r in registry.call_sites(p).orderBy("idx").collect()] == [args, args, [], []]
