"""The machine's binary and unary operators as Column expressions; what cannot be computed is null.

``/`` is true division, ``//`` and ``%`` are floored, ``and`` and ``or`` give one of their operands, equality knows null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(a: Column, kind: str = "number") -> Column:
    if kind == "string":
        return F.coalesce(a != "", F.lit(False))
    if kind == "boolean":
        return F.coalesce(a, F.lit(False))
    return F.coalesce(a != 0, F.lit(False))


def floor_div(a, b):
    return F.floor(F.try_divide(a, b))


BINARY = {
    "+": lambda a, b: F.try_add(a, b), "-": lambda a, b: F.try_subtract(a, b), "*": lambda a, b: F.try_multiply(a, b), "/": F.try_divide, "//": floor_div, "%": lambda a, b: a - b * floor_div(a, b), "mod": lambda a, b: a - b * floor_div(a, b), "**": F.pow,
    "==": lambda a, b: a.eqNullSafe(b), "===": lambda a, b: a.eqNullSafe(b), "is": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), "~=": lambda a, b: ~a.eqNullSafe(b), "is not": lambda a, b: ~a.eqNullSafe(b),
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "and": lambda a, b: F.when(truthy(a), b).otherwise(a), "&&": lambda a, b: F.when(truthy(a), b).otherwise(a), "or": lambda a, b: F.when(truthy(a), a).otherwise(b), "||": lambda a, b: F.when(truthy(a), a).otherwise(b),
    "in": lambda a, b: F.array_contains(b, a), "not in": lambda a, b: ~F.array_contains(b, a), "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b), "~": lambda a, b: a.bitwiseXOR(b),
    "<<": lambda a, b: F.call_function("shiftleft", a, b.cast("int")), ">>": lambda a, b: F.call_function("shiftright", a, b.cast("int")), ">>>": lambda a, b: F.lit(None),
    "..": lambda a, b: F.concat(a.cast("string"), b.cast("string")), ".": lambda a, b: F.concat(a.cast("string"), b.cast("string")), "?:": F.coalesce, "??": F.coalesce,
}
UNARY = {"-": F.negative, "+": F.positive, "not": lambda a: ~truthy(a), "!": lambda a: ~truthy(a), "~": F.bitwise_not, "#": F.length, "!!": lambda a: a, "&": lambda a: a, "<-": lambda a: F.lit(None)}
