"""Records whose tables depend on counters inside them (OCCURS ... DEPENDING ON), nested to any depth, and names for runs of fields (RENAMES).

A layout is a list of fields (name, width), tables :class:`Depending` and, at the top, :class:`Renames`. A field's place is the running
sum of all widths before it in this record, so what follows a table moves with its counter. All are Columns on the JVM side; a
table's entries are read one behind the other, each starting where the one before it ended.

A null record gives nulls; a record that ends early gives empty or cut fields; a counter that is no number, or less than 0, counts as 0,
and one above ``most`` as ``most``. When written, values are cut or padded: numbers with zeros on the left, texts with blanks on the right; a null is all
padding; a null table is empty, and its counter is written from its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Depending:
    name: str
    counter: str
    most: int
    fields: tuple


@dataclass(frozen=True)
class Renames:
    name: str
    first: str
    last: str


def _count(text: Column, most: int) -> Column:
    n = F.when(text.rlike("^ *[0-9]+ *$"), F.trim(text).try_cast("int")).otherwise(0)
    return F.least(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.lit(most))


def _type(fields: tuple) -> str:
    parts = []
    for f in fields:
        if isinstance(f, Depending):
            parts.append(f"`{f.name}`:array<struct<`{f.name}_at`:int,{_type(f.fields)}>>")
        elif not isinstance(f, Renames):
            parts.append(f"`{f[0]}`:string")
    return ",".join(parts)


def _reader(record: Column, table: Depending, item: str):
    """A step that reads the table's next entry, for an aggregate over (place, entries)."""

    def step(acc: Column, _: Column) -> Column:
        inner, end, _ = _fields(record, table.fields, acc["at"])
        entry = F.struct(acc["at"].alias(f"{table.name}_at"), *[v.alias(k) for k, v in inner.items()]).cast(item)
        return F.struct(end.cast("int").alias("at"), F.concat(acc["items"], F.array(entry)).alias("items"))

    return step


def _fields(record: Column, fields: tuple, at: Column) -> tuple[dict[str, Column], Column, dict[str, tuple[Column, Column]]]:
    """(values, place behind the last, (start, stop) of each field) of ``fields`` from place ``at`` (0 is the first) on."""
    values, spans = {}, {}
    for f in fields:
        start = at
        if isinstance(f, Depending):
            item = f"struct<`{f.name}_at`:int,{_type(f.fields)}>"
            none = F.array().cast(f"array<{item}>")

            n = _count(values[f.counter], f.most)
            steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
            read = F.aggregate(steps, F.struct(at.cast("int").alias("at"), none.alias("items")), _reader(record, f, item))
            values[f.name], at = F.when(record.isNotNull(), read["items"]), read["at"]
        else:
            name, width = f
            values[name], at = record.substr((at + 1).cast("int"), F.lit(width)), at + width
        spans[f.name if isinstance(f, Depending) else f[0]] = (start, at)
    return values, at, spans


def parse(record: Column, layout: tuple) -> dict[str, Column]:
    """The Columns of a record's fields by name: texts, arrays of structs for tables (with ``<table>_at``, each entry's place), texts for renamed runs."""
    values, _, spans = _fields(record, tuple(f for f in layout if not isinstance(f, Renames)), F.lit(0))
    for f in layout:
        if isinstance(f, Renames):
            start, stop = spans[f.first][0], spans[f.last][1]
            values[f.name] = record.substr((start + 1).cast("int"), (stop - start).cast("int"))
    return values


def _writer(table: Depending, numbers: frozenset):
    return lambda entry: write(table.fields, lambda name: entry[name], numbers)


def write(layout: tuple, value, numbers: frozenset = frozenset()) -> Column:
    """The record of ``value`` (a function from a field's name to its Column); fields in ``numbers`` are padded with zeros on the left."""
    tables = {f.counter: f.name for f in layout if isinstance(f, Depending)}
    parts = []
    for f in layout:
        if isinstance(f, Renames):
            continue
        if isinstance(f, Depending):
            parts.append(F.coalesce(F.array_join(F.transform(value(f.name), _writer(f, numbers)), ""), F.lit("")))
            continue
        name, width = f
        if name in tables:
            parts.append(F.lpad(F.coalesce(F.array_size(value(tables[name])), F.lit(0)).cast("string"), width, "0"))
        else:
            text = F.coalesce(value(name).cast("string"), F.lit(""))
            parts.append(F.lpad(text, width, "0") if name in numbers else F.rpad(text, width, " "))
    return F.concat(*parts)
