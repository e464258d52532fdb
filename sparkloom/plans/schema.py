"""The instruction model: opcodes, their kinds, and the type lattice, as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Opcode, category, operand names.
OPCODES = (
    ("CONST", "value", "literal"), ("LOAD_VAR", "value", "name"), ("LOAD_FIELD", "value", "object, field"), ("LOAD_INDEX", "value", "array, index"),
    ("NEW_OBJECT", "value", "type"), ("NEW_ARRAY", "value", "type, size"), ("BINOP", "value", "operator, left, right"), ("UNOP", "value", "operator, operand"),
    ("CALL_FUNCTION", "call", "function, arguments"), ("CALL_METHOD", "call", "object, method, arguments"), ("CALL_UNKNOWN", "call", "target, arguments"),
    ("CALL_CTOR", "call", "type, arguments"), ("CALL_WITH_MEMORY", "call", "program, regions"),
    ("DECL_VAR", "store", "name, value"), ("STORE_VAR", "store", "name, value"), ("STORE_FIELD", "store", "object, field, value"), ("STORE_INDEX", "store", "array, index, value"),
    ("BRANCH_IF", "control", "condition"), ("BRANCH", "control", ""), ("RETURN", "control", "value"), ("THROW", "control", "value"), ("HALT", "control", ""),
    ("TRY_PUSH", "control", "handlers"), ("TRY_POP", "control", ""), ("SYMBOLIC", "special", "hint"),
    ("ALLOC_REGION", "memory", "size"), ("WRITE_REGION", "memory", "region, offset, length, value"), ("LOAD_REGION", "memory", "region, offset, length"),
    ("SET_CONTINUATION", "control", "name, label"), ("RESUME_CONTINUATION", "control", "name"), ("SUSPEND", "control", "value"),
    ("ADDRESS_OF", "memory", "name"), ("LOAD_INDIRECT", "memory", "pointer"), ("LOAD_FIELD_INDIRECT", "memory", "object, field register"), ("STORE_INDIRECT", "memory", "pointer, value"),
    ("IMPORT_MODULE", "special", "path"), ("LABEL", "special", ""),
)

#: The type lattice (name, parent).
TYPES = (("Any", ""), ("Number", "Any"), ("Int", "Number"), ("Float", "Number"), ("String", "Any"), ("Bool", "Any"), ("Object", "Any"), ("Array", "Object"), ("Pointer", "Any"), ("Map", "Object"), ("Tuple", "Object"), ("Region", "Any"))

#: Opcodes after which a new block begins.
ENDS_BLOCK = ("BRANCH", "BRANCH_IF", "RETURN", "THROW", "HALT", "RESUME_CONTINUATION")
#: Opcodes that never fall through.
NO_FALL = ("BRANCH", "BRANCH_IF", "RETURN", "THROW", "HALT")

INSTR = "program_id bigint, pc int, opcode string, result_reg string, operands array<string>, label string, branch_targets array<string>"


def opcode_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OPCODES), "opcode string, category string, fields string")


def type_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPES), "name string, parent string")


def values_sql(rows, names: str) -> str:
    """The rows as a SQL table expression, for the oracle side."""
    body = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS dim({names})"
