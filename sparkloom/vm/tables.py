"""The frontend and the machine as table functions: sources in, instructions, results or steps out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


#: Languages in which a field of ``this`` goes by its bare name.
IMPLICIT_THIS = ("java", "csharp", "kotlin", "scala", "cpp")


class LowerSource:
    """``LATERAL lower_source(source, language)``: one row an instruction; unknown languages give one unknown."""

    def eval(self, source: str, language: str):
        from sparkloom.frontends import lower

        code = lower(source, language)
        for pc, (op, reg, ops, label, targets) in enumerate(code):
            yield pc, op, reg, [str(x) for x in ops], label, targets


class LowerCode:
    """``LATERAL lower_code(source, language)``: as ``lower_source``, with the operands of CONST as JSON, so that the table can be linked and run."""

    def eval(self, source: str, language: str):
        from sparkloom.frontends import lower

        for pc, (op, reg, ops, label, targets) in enumerate(lower(source, language)):
            yield pc, op, reg, [_json_of(ops[0])] if op == "CONST" else [str(x) for x in ops], label, targets


class RunSource:
    """``LATERAL run_source(source, language, variable, most)``: the JSON of one variable after at most ``most`` steps."""

    def eval(self, source: str, language: str, variable: str, most: int):
        from sparkloom.frontends import lower
        from sparkloom.vm.machine import Machine

        m = Machine(lower(source, language), implicit_this=language in IMPLICIT_THIS).run(most)
        yield json.dumps(m.plain(m.frames[0].vars.get(variable))), m.steps, m.done, None if m.error is None else str(m.error)


class RunCode:
    """``LATERAL run_code(code, variable, implicit_this, most)``: instructions as JSON rows [opcode, register, operands, label, targets], then as ``run_source``, with path conditions and the output."""

    def eval(self, code: str, variable: str, implicit_this: bool, most: int):
        from sparkloom.vm.machine import Class, Func, Machine

        def literal(x):
            if isinstance(x, dict):
                return Func(x["func"]) if "func" in x else Class(x["class"], tuple(x.get("parents", ())), tuple(map(tuple, x.get("methods", ()))))
            return x

        rows = [(op, reg, [literal(x) for x in ops], label, targets) for op, reg, ops, label, targets in json.loads(code)]
        m = Machine(rows, implicit_this=implicit_this).run(most)
        yield json.dumps(m.plain(m.frames[0].vars.get(variable))), m.steps, m.done, m.conditions, m.out


class TraceSource:
    """``LATERAL trace_source(source, most)``: a row a step with the current frame's variables."""

    def eval(self, source: str, most: int):
        from sparkloom.frontends.python_ast import lower
        from sparkloom.vm.machine import Machine

        trace: list = []
        Machine(lower(source)).run(most, trace)
        for step, pc, op, variables in trace:
            yield step, pc, op, {k: json.dumps(v) for k, v in variables.items()}


#: Name of each table function, its class and the columns it returns.
FUNCTIONS = {
    "lower_source": (LowerSource, "pc int, opcode string, result_reg string, operands array<string>, label string, branch_targets array<string>"),
    "lower_code": (LowerCode, "pc int, opcode string, result_reg string, operands array<string>, label string, branch_targets array<string>"),
    "run_source": (RunSource, "answer string, steps int, finished boolean, error string"),
    "run_code": (RunCode, "answer string, steps int, finished boolean, conditions array<string>, output array<string>"),
    "trace_source": (TraceSource, "step int, pc int, opcode string, variables map<string, string>"),
}


def register(spark) -> None:
    for name, (cls, returns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=returns))


def run_over(df: DataFrame, source: str, inputs: list[str], result: str, most: int = 2000) -> DataFrame:
    """``df`` with ``answer`` and ``finished``: the program runs once for each row, with the row's columns as its variables. Lowered once a task.

    A batch's rows run together as columns (``vm.columns``); rows that leave whole numbers and truth values, and null inputs, run in a machine each.
    A run that has not ended after ``most`` steps has no answer and is not finished.
    """
    schema = df.withColumns({"answer": F.lit(None).cast("string"), "finished": F.lit(None).cast("boolean")}).schema

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from sparkloom.frontends.python_ast import lower
        from sparkloom.vm.columns import Columns
        from sparkloom.vm.machine import Machine

        code = lower(source)
        for batch in batches:
            given = {c: batch.column(c) for c in inputs}
            whole = [pa.types.is_boolean(x.type) or pa.types.is_signed_integer(x.type) for x in given.values()]
            out, ended, alone = [None] * batch.num_rows, [False] * batch.num_rows, np.ones(batch.num_rows, bool)
            if all(whole):
                there = np.ones(batch.num_rows, bool)
                for x in given.values():
                    there &= x.is_valid().to_numpy(zero_copy_only=False)
                numbers = {c: x.fill_null(0 if pa.types.is_integer(x.type) else False).to_numpy(zero_copy_only=False) for c, x in given.items()}
                runs = Columns(code, {c: x[there] for c, x in numbers.items()}, int(there.sum())).run(most)
                for k, answer, done, left in zip(np.flatnonzero(there).tolist(), runs.answers(result), runs.finished.tolist(), runs.left.tolist()):
                    out[k], ended[k], alone[k] = answer, done, left
            for k in np.flatnonzero(alone).tolist():
                m = Machine(code, {c: x[k].as_py() for c, x in given.items()}).run(most)
                out[k], ended[k] = json.dumps(m.plain(m.frames[0].vars.get(result))) if m.done else None, m.done
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(ended, pa.bool_())], names=[*batch.schema.names, "answer", "finished"])

    return df.mapInArrow(work, schema)


def run_table(code: DataFrame, variable: str, entry: str | None = None, most: int = 20_000) -> DataFrame:
    """(program_id, answer, result, finished): every program of an instruction table (literals as JSON) run, one task a program.

    First the top level, modules in their order; then, if given, the function ``entry`` (the last of that bare name) without arguments:
    ``answer`` is the variable after the first, ``result`` what the second returned.
    """
    from sparkloom.operators.registry import FUNC
    from sparkloom.plans import fixpoint

    def solve(rows):
        import re

        from sparkloom.vm.machine import Func, Machine

        m = Machine([(op, reg, [_literal(ops[0])] if op == "CONST" else list(ops), label, list(to)) for _, op, reg, ops, label, to in sorted(rows, key=lambda r: r[0])]).run(most)
        answer = json.dumps(m.plain(m.frames[0].vars.get(variable)))
        named = [x for x in m.labels if entry and (found := re.match(FUNC, x)) and found[1] == entry]
        result = None
        if named and m.done and m.error is None:
            m.done, m.pc = False, len(m.code)
            m.call(Func(named[-1]), [], "%entry")
            m.run(m.steps + most)
            result = json.dumps(m.plain(m.frames[0].regs.get("%entry")))
        yield answer, result, m.done

    kind = code.schema["program_id"].dataType.simpleString()
    rows = code.select("program_id", "pc", "opcode", "result_reg", "operands", "label", "branch_targets")
    return fixpoint.per_key(rows, "program_id", solve, f"program_id {kind}, answer string, result string, finished boolean")


def _json_of(v) -> str:
    from sparkloom.vm.machine import Class, Func

    if isinstance(v, Func):
        v = {"func": v.label}
    elif isinstance(v, Class):
        v = {"class": v.name, "parents": list(v.parents), "methods": [list(x) for x in v.methods]}
    return json.dumps(v, default=str)


def _literal(text: str):
    from sparkloom.vm.machine import Class, Func

    x = json.loads(text)
    if isinstance(x, dict):
        return Func(x["func"]) if "func" in x else Class(x["class"], tuple(x["parents"]), tuple(map(tuple, x["methods"])))
    return x
