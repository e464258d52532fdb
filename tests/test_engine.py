"""Hand-built programs, the machine, types, codecs, files and streams."""

import datetime
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.frontends import lower as lower_any
from sparkloom.frontends.python_ast import lower
from sparkloom.functions import codecs as C
from sparkloom.functions import intrinsics as I
from sparkloom.operators import cfg, dataflow, types
from sparkloom.plans import fixpoint
from sparkloom.plans.language_queries import FACTORIALS, GOLDEN
from sparkloom.plans.schema import INSTR, OPCODES
from sparkloom.sources import records as R
from sparkloom.vm.machine import BINOPS, Machine, Symbol

PROGRAM = [
    (1, 0, "LABEL", "", [], "entry", []),
    (1, 1, "CONST", "%0", ["1"], "", []),
    (1, 2, "STORE_VAR", "", ["x", "%0"], "", []),
    (1, 3, "BRANCH_IF", "", ["%0"], "", ["yes", "no"]),
    (1, 4, "LABEL", "", [], "yes", []),
    (1, 5, "LOAD_VAR", "%1", ["x"], "", []),
    (1, 6, "STORE_VAR", "", ["y", "%1"], "", []),
    (1, 7, "BRANCH", "", [], "", ["end"]),
    (1, 8, "LABEL", "", [], "no", []),
    (1, 9, "STORE_VAR", "", ["x", "%0"], "", []),
    (1, 10, "LABEL", "", [], "end", []),
    (1, 11, "LOAD_VAR", "%2", ["x"], "", []),
    (1, 12, "RETURN", "", ["%2"], "", []),
    (1, 13, "CONST", "%3", ["0"], "", []),
]


@pytest.fixture(scope="module")
def placed(spark):
    return cfg.placed(spark.createDataFrame(PROGRAM, INSTR)).cache()


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_cfg(placed):
    b = cfg.blocks(placed)
    assert rows(b.select("block_ord", "label", "n_instr")) == {(0, "entry", 3), (1, "yes", 3), (2, "no", 1), (3, "end", 2), (4, "__block_13", 1)}
    assert rows(cfg.edges(b).select("src", "dst", "ord")) == {("entry", "yes", 0), ("entry", "no", 1), ("yes", "end", 0), ("no", "end", 0)}


def test_duplicate_labels_keep_the_last_in_the_first_place(spark):
    p = [(1, 0, "LABEL", "", [], "a", []), (1, 1, "HALT", "", [], "", []), (1, 2, "LABEL", "", [], "b", []), (1, 3, "LABEL", "", [], "a", []), (1, 4, "RETURN", "", [], "", [])]
    b = cfg.blocks(cfg.placed(spark.createDataFrame(p, INSTR)))
    assert rows(b.select("block_ord", "label", "last_op")) == {(0, "a", "RETURN"), (1, "b", "LABEL")} or rows(b.select("block_ord", "label", "last_op")) == {(0, "a", "RETURN"), (1, "b", "LABEL")}


def test_dataflow(placed):
    defs = cfg.writes(placed)
    reach = dataflow.reaching(dataflow.gen(defs), cfg.edges(cfg.blocks(placed)))
    assert {r for r in rows(reach.select("block", "var", "def_block")) if r[0] == "end" and r[1] == "x"} == {("end", "x", "entry"), ("end", "x", "no")}
    chains = rows(dataflow.def_use(defs, cfg.reads(placed), reach).where("var = 'x'").select("def_block", "def_idx", "use_block", "use_idx"))
    assert chains == {("entry", 1, "yes", 0), ("entry", 1, "end", 0), ("no", 0, "end", 0)}


def test_function_ranges_and_text(spark):
    p = [(1, 0, "BRANCH", "", [], "", ["end_f_1"]), (1, 1, "LABEL", "", [], "func_f_0", []), (1, 2, "SYMBOLIC", "%0", ["param:x"], "", []), (1, 3, "LABEL", "", [], "end_f_1", [])]
    placed = cfg.placed(spark.createDataFrame(p, INSTR))
    assert rows(cfg.subgraph_ranges(placed).select("start_label", "end_label", "start_pc", "end_pc")) == {("func_f_0", "end_f_1", 1, 3)}
    assert rows(cfg.text(placed).select("pc", "line")) == {(0, "branch end_f_1"), (1, "func_f_0:"), (2, "%0 = symbolic param:x"), (3, "end_f_1:")}


EDGES = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (2, "a", "d")]


def test_fixpoints(spark):
    e = spark.createDataFrame(EDGES, "k bigint, src string, dst string")
    want = {(1, s, d) for s in "abc" for d in "abcd"} | {(2, "a", "d")}
    assert rows(fixpoint.closure(e, ["k"])) == rows(fixpoint.closure_by_key(e, "k")) == want
    assert rows(fixpoint.components_by_key(e, "k")) == {(1, "a", "a"), (1, "b", "a"), (1, "c", "a"), (1, "d", "d"), (2, "a", "a"), (2, "d", "d")}
    paths = fixpoint.shortest_paths(e, spark.createDataFrame([(1, "a")], "k bigint, node string"), ["k"])
    assert {(r.node, tuple(r.path)) for r in paths.collect()} == {("a", ("a",)), ("b", ("a", "b")), ("c", ("a", "b", "c")), ("d", ("a", "b", "c", "d"))}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("y",)], "node string")
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert dict(fixpoint.levels(nodes, deps).collect()) == {"c": 0, "b": 1, "a": 2, "x": 3, "y": 3}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden_programs(name):
    source, answer = GOLDEN[name]
    m = Machine(lower(source)).run(20_000)
    assert m.done and m.plain(m.frames[0].vars["answer"]) == answer


@pytest.mark.parametrize("language", sorted(FACTORIALS))
def test_every_language(language):
    m = Machine(lower_any(FACTORIALS[language], language)).run(5000)
    assert m.done and m.frames[0].vars.get("answer", m.frames[0].vars.get("ANSWER")) == 120


COBOL = """       DATA DIVISION.
       01 N PIC 9(4) VALUE 5.
       01 T PIC X(3) VALUE 'abcd'.
       01 Q PIC S9(3)V99 VALUE -1.25.
       01 I PIC 9(2).
       01 S PIC 9(3) VALUE 0.
       PROCEDURE DIVISION.
       A-PARA.
           IF Q IS NEGATIVE AND NOT N = 7 THEN MOVE 'xy' TO T ELSE MOVE 'no' TO T END-IF.
           EVALUATE N WHEN 0 MOVE 9 TO Q WHEN 4 THRU 6 MOVE 2.555 TO Q WHEN OTHER MOVE 7 TO Q END-EVALUATE.
           PERFORM VARYING I FROM 1 BY 1 UNTIL I > 4 ADD I TO S END-PERFORM.
           PERFORM B-PARA 2 TIMES.
           DIVIDE 7 BY 2 GIVING N REMAINDER I.
           DISPLAY T S.
           STOP RUN.
       B-PARA.
           ADD 100 TO S.
"""


def test_cobol():
    m = Machine(lower_any(COBOL, "cobol")).run(5000)
    assert {k: m.frames[0].vars[k] for k in "NTQIS"} == {"N": 3, "T": "xy ", "Q": 2.55, "I": 1, "S": 210} and m.out == ["xy  210"]


def test_unknown_language_and_bad_source():
    assert lower_any("x", "klingon")[1][2] == ["unsupported:klingon"] and lower_any("def (", "python")[1][2] == ["unsupported:syntax"]
    for language in FACTORIALS:
        assert lower_any("@@ ?? ))) {{{ 1 +", language)


def test_machine_handles_every_opcode():
    handled = {n[1:].upper() for n in dir(Machine) if n.startswith("_") and not n.startswith("__")}
    assert {o for o, _, _ in OPCODES} <= handled


def run(*code, **variables):
    return Machine([(op, reg, list(ops), label, list(targets)) for op, reg, ops, label, targets in code], variables).run(1000)


def test_symbols_regions_pointers_and_continuations():
    m = run(("LOAD_VAR", "%0", ["unknown"], "", []), ("BINOP", "%1", ["+", "%0", 1], "", []), ("BINOP", "%2", ["==", "%0", None], "", []), ("BRANCH_IF", "", ["%1"], "", ["yes", "no"]), ("LABEL", "", [], "no", []), ("HALT", "", [], "", []), ("LABEL", "", [], "yes", []), ("STORE_VAR", "", ["r", "%2"], "", []))
    assert isinstance(m.frames[0].regs["%1"], Symbol) and m.frames[0].vars["r"] is False and len(m.conditions) == 1
    m = run(("ALLOC_REGION", "%0", [4], "", []), ("WRITE_REGION", "", ["%0", 1, 2, [7, 8]], "", []), ("LOAD_REGION", "%1", ["%0", 0, 4], "", []))
    assert m.frames[0].regs["%1"] == [0, 7, 8, 0]
    m = run(("ADDRESS_OF", "%0", ["x"], "", []), ("STORE_INDIRECT", "", ["%0", 9], "", []), ("LOAD_VAR", "%1", ["x"], "", []), ("LOAD_INDIRECT", "%2", ["%0"], "", []), x=1)
    assert m.frames[0].regs["%1"] == m.frames[0].regs["%2"] == 9
    m = run(("SET_CONTINUATION", "", ["c", "out"], "", []), ("RESUME_CONTINUATION", "", ["c"], "", []), ("STORE_VAR", "", ["x", 2], "", []), ("LABEL", "", [], "out", []), ("RESUME_CONTINUATION", "", ["c"], "", []), ("STORE_VAR", "", ["y", 3], "", []), x=1)
    assert m.frames[0].vars["x"] == 1 and m.frames[0].vars["y"] == 3


def test_step_cap_and_suspension():
    assert not Machine(lower("while True:\n  x = 1")).run(50).done
    m = Machine(lower("t = 0\nwhile True:\n  t = t + suspend(t)")).run(100)
    for v in (5, 6):
        m.resume(v, 100)
    assert m.waiting[1] == 11 and m.snapshot().resume(1, 100).waiting[1] == 12 and m.waiting[1] == 11


def test_unsupported_source_is_an_unknown():
    assert any(op == "SYMBOLIC" and ops[0].startswith("unsupported:") for op, _, ops, _, _ in lower("x = yield_ if (await_ := 1) else 2\nasync def f(): pass"))


def test_operator_tables_agree(spark):
    """Column operators against the machine's, all four pairs of signs."""
    from sparkloom.functions.operators import BINARY

    pairs = [(a, b) for a in (-7, 7, 0, 5) for b in (-2, 2, 3)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for op in ("+", "-", "*", "/", "//", "%", "==", "!=", "<", ">=", "and", "or", "&", "|", "^"):
        got = {(r.a, r.b): r.v for r in df.select("a", "b", BINARY[op](F.col("a"), F.col("b")).alias("v")).collect()}
        assert got == {(a, b): BINOPS[op](a, b) for a, b in pairs}, op


NAMES = ["Any", "Number", "Int", "Float", "String", "Array[Int]", "Array[Number]", "Union[Int, String]", "Fn(Int) -> Int", "Map[String, Int]"]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(NAMES), st.sampled_from(NAMES))
def test_bounds_are_above(a, b):
    x, y = types.parse(a), types.parse(b)
    top = types.lub(x, y)
    assert types.is_subtype(x, x) and types.parse(types.show(x)) == x
    if x[0] != "Fn" and y[0] != "Fn":
        assert types.is_subtype(x, top) and types.is_subtype(y, top)


VALUES = ["0", "-0", "12.345", "-7", "99999", "+3.1", "-12345.678"]


def test_codecs_round_trip(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    v = F.col("v")
    out = df.select("v", F.hex(C.zoned(v, 7, 2, True)).alias("z"), C.from_zoned(C.zoned(v, 7, 2, True), 2).alias("zb"), F.hex(C.packed(v, 7, 2, True)).alias("p"), C.from_packed(C.packed(v, 7, 2, True), 2).alias("pb")).collect()
    for r in out:
        cut = int(abs(float(r.v)) * 100 + 1e-9) / 100 * (-1 if r.v.startswith("-") else 1)
        assert r.zb == pytest.approx(cut) and r.pb == pytest.approx(cut)
        assert len(r.z) == 14 and len(r.p) == 8 and r.p[-1] == ("D" if cut < 0 else "C")
    n = spark.createDataFrame([(x,) for x in (0, 1, -1, 32767, -32768, 2**31 - 1, -(2**31), 2**62, -(2**63))], "n bigint")
    for r in n.select("n", I.int_to_binary_bytes(F.col("n"), 8).alias("b"), I.binary_bytes_to_int(I.int_to_binary_bytes(F.col("n"), 8), 8).alias("back")).collect():
        assert bytes(r.b) == struct.pack(">q", r.n) and r.back == r.n
    text = "Hello, World 09 <>!"
    r = spark.createDataFrame([(text,)], "s string").select(C.to_ebcdic(F.col("s")).alias("e"), C.from_ebcdic(C.to_ebcdic(F.col("s"))).alias("b")).first()
    assert bytes(r.e) == text.encode("cp037") and r.b == text


@pytest.mark.parametrize("value, pic, shown", [("1234.5", "ZZ,ZZ9.99", " 1,234.50"), ("0", "ZZZ9", "   0"), ("-42", "+ZZ9", "- 42"), ("42", "-999", " 042"), ("7", "9(3)", "007"), ("0", "ZZZ", "   "), ("12345", "99B999", "12 345")])
def test_pictures(spark, value, pic, shown):
    assert spark.range(1).select(C.apply_picture(F.lit(value), pic).alias("x")).first().x == shown
    assert C.parse_picture("S9(5)V99") == {"kind": "zoned", "digits": 7, "decimals": 2, "signed": True, "size": 7}


def test_intrinsics(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(I.integer_of_date(F.lit(20240101))) == 154498 == (datetime.date(2024, 1, 1) - datetime.date(1600, 12, 31)).days
    assert one(I.numval(F.lit(" 12.5 CR"))) == -12.5 and one(I.numval(F.lit("1x"))) is None and one(I.numval(F.lit(" "))) == 0
    assert one(I.string_replace(F.lit("aab"), "a", "x", "leading")) == "xab" and one(I.string_replace(F.lit("aab"), "a", "", "leading")) == "b"
    with pytest.raises(ValueError):
        I.string_replace(F.lit("a"), "a", "ab", "leading")
    assert one(I.multi_delimiter_consumed_length(F.lit("a,b;c"), 2, ",", ";")) == 4 and one(I.multi_delimiter_consumed_length(F.lit("a,b;c"), 3, ",", ";")) == 5
    assert one(I.mod(F.lit(-7), F.lit(3))) == 2 and one(I.rem(F.lit(-7), F.lit(3))) == -1 and one(I.mod(F.lit(1), F.lit(0))) is None
    assert one(I.year_to_yyyy(F.lit(49))) == 2049 and one(I.year_to_yyyy(F.lit(50))) == 1950
    assert one(I.factorial(F.lit(25))) == 15511210043330985984000000
    assert one(I.boundary_split(F.lit("ab.cd"), ".", "after")) == ["cd", "ab."] and one(I.string_zfill(F.lit("-7"), 4)) == "-007"
    assert one(I.variance(F.lit(4))) == 0 and one(I.string_count(F.lit("aaab"), "aa", "all")) == 1


def test_record_files(spark, tmp_path):
    (tmp_path / "f.dat").write_bytes(b"AAAABBBBCC")
    assert [(r.nth, bytes(r.record)) for r in R.read_sequential(spark, str(tmp_path), 4).orderBy("nth").collect()] == [(0, b"AAAA"), (1, b"BBBB"), (2, b"CC")]
    f = spark.createDataFrame([(1, "a"), (3, "c")], "key bigint, record string")
    f2, told = R.insert(f, spark.createDataFrame([(1, "x"), (2, "b"), (2, "bb")], "key bigint, record string"))
    assert rows(f2) == {(1, "a"), (2, "b"), (3, "c")} and sorted(r.status for r in told.collect()) == ["00", "22", "22"]
    f3, told = R.rewrite(f2, spark.createDataFrame([(3, "z"), (9, "q")], "key bigint, record string"))
    assert rows(f3) == {(1, "a"), (2, "b"), (3, "z")} and rows(told) == {(3, "00"), (9, "23")}
    f4, told = R.delete(f3, spark.createDataFrame([(1,), (8,)], "key bigint"))
    assert rows(f4) == {(2, "b"), (3, "z")} and rows(told) == {(1, "00"), (8, "23")}
