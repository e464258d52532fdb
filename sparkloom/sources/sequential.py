"""Sequential files of fixed-length records as a Spark data source: byte-range partitions, chosen fields, a committing writer.

A file is a folder of parts whose names are in order; a part is records one behind the other, without separators. Reading
cuts each part into ranges of whole records, so one large part is read by many tasks, and only the asked fields are cut out of
a range's bytes. Writing puts each task's records under ``_writing`` and moves them into place when all tasks are done: a task
that fails or is run again leaves nothing behind. Parts follow the partitions of the written table, so a table sorted
by range is a sorted file; an appended table's parts come after all others.

Paths are those that Arrow's file systems know: local or mounted folders, object stores, HDFS where libhdfs is installed.
The last record of a part may be short (its missing fields are null, a cut field is as long as it is); an empty
folder is an empty table; null records are refused when written, others are padded with blanks or refused if they are longer.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

WRITING = "_writing"
SPLIT = 32 << 20
CHUNK = 1 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parts(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the folder's parts, in order."""
    from pyarrow import fs

    system, root = _fs(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.startswith("part-"))


@dataclass
class Range(InputPartition):
    part: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    at: int
    place: str


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[tuple[str, int, int]]):
        self.path, self.size, self.fields = options["path"], int(options["size"]), fields
        self.split = max(self.size, int(options.get("split", SPLIT)) // self.size * self.size)
        self.only = options.get("part")

    def partitions(self) -> list[Range]:
        at = [(p, n) for p, n in parts(self.path) if self.only is None or p.rsplit("/", 1)[-1] == self.only]
        return [Range(p, s, min(s + self.split, n)) for p, n in at for s in range(0, n, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range):
        import numpy as np
        import pyarrow as pa

        if partition.stop <= partition.start:
            return
        system, _ = _fs(self.path)
        name, step = partition.part.rsplit("/", 1)[-1], max(1, CHUNK // self.size) * self.size
        with system.open_input_file(partition.part) as f:
            for at in range(partition.start, partition.stop, step):
                data = f.read_at(min(step, partition.stop - at), at)
                whole = len(data) // self.size
                rows = np.frombuffer(data[: whole * self.size], np.uint8).reshape(whole, self.size)
                rest = data[whole * self.size :]
                n = whole + bool(rest)
                columns = [pa.array([name] * n, pa.string()), pa.array(range(at // self.size, at // self.size + n), pa.int64())]
                for _, offset, width in self.fields:
                    cut = np.ascontiguousarray(rows[:, offset : offset + width])
                    values = pa.Array.from_buffers(pa.binary(width), whole, [None, pa.py_buffer(cut.tobytes())]).cast(pa.binary())
                    columns.append(pa.concat_arrays([values, pa.array([rest[offset : offset + width] or None], pa.binary())]) if rest else values)
                yield pa.RecordBatch.from_arrays(columns, names=["part", "nth", *[f for f, _, _ in self.fields]])


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.size, self.overwrite, self.replaces = options["path"], int(options["size"]), overwrite, options.get("part")
        self.writing = f"{WRITING}-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        system, root = _fs(self.path)
        context = TaskContext.get()
        place = f"{root}/{self.writing}/{context.partitionId():08d}-{context.taskAttemptId()}"
        system.create_dir(f"{root}/{self.writing}", recursive=True)
        with system.open_output_stream(place) as out:
            for batch in iterator:
                records = batch.column(batch.schema.get_field_index("record")).to_pylist()
                if any(r is None or len(r) > self.size for r in records):
                    raise ValueError(f"a record is missing or longer than {self.size} bytes")
                out.write(b"".join(bytes(r).ljust(self.size) for r in records))
        return Written(context.partitionId(), place)

    def commit(self, messages) -> None:
        system, root = _fs(self.path)
        old = parts(self.path)
        if self.replaces is None:
            first = 0 if self.overwrite or not old else int(old[-1][0].rsplit("part-", 1)[1]) + 1
            if self.overwrite:
                for p, _ in old:
                    system.delete_file(p)
            names = [f"part-{first + k:08d}" for k in range(len(messages))]
        else:
            names = [self.replaces]
        for name, m in zip(names, sorted((m for m in messages if m), key=lambda m: m.at), strict=True):
            system.move(m.place, f"{root}/{name}")
        system.delete_dir(f"{root}/{self.writing}")

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, root = _fs(self.path)
        if system.get_file_info(f"{root}/{self.writing}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.writing}")


class RecordFiles(DataSource):
    """Options: path, size (bytes of a record), split (bytes of a range), fields (name:offset:width,...; the whole record if unset), part."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def _fields(self) -> list[tuple[str, int, int]]:
        asked = self.options.get("fields")
        return [(n, int(o), int(w)) for n, o, w in (f.split(":") for f in asked.split(","))] if asked else [("record", 0, int(self.options["size"]))]

    def schema(self) -> str:
        return "part string, nth bigint" + "".join(f", `{n}` binary" for n, _, _ in self._fields())

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options), self._fields())

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, size: int, fields: dict[str, tuple[int, int]] | None = None, **options) -> DataFrame:
    """(part, nth, one binary column a field (offset, width), or ``record``) of the file at ``path``."""
    spark.dataSource.register(RecordFiles)
    chosen = {"fields": ",".join(f"{n}:{o}:{w}" for n, (o, w) in fields.items())} if fields else {}
    return spark.read.format("records").options(path=path, size=str(size), **chosen, **{k: str(v) for k, v in options.items()}).load()


def write(records: DataFrame, path: str, size: int, mode: str = "overwrite", **options) -> None:
    """Writes ``records`` (record: binary), in the order of their partitions; ``mode`` append puts them behind all others."""
    records.sparkSession.dataSource.register(RecordFiles)
    records.select(F.col("record").cast("binary").alias("record")).write.format("records").options(path=path, size=str(size), **options).mode(mode).save()


def numbered(file: DataFrame) -> DataFrame:
    """``file`` with ``at``, each record's place in the whole file from 0; one row a part is ordered in one task."""
    counts = file.groupBy(F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return file.join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("at", F.col("nth") + F.col("before")).drop("p", "before")


def rewrite_last(spark: SparkSession, path: str, size: int, record: bytes) -> None:
    """The last record of the file replaced: its part alone is read and written anew; the others are not touched."""
    found = [(p, n) for p, n in parts(path) if n]
    if not found:
        raise ValueError("the file has no record")
    name, n = found[-1][0].rsplit("/", 1)[-1], found[-1][1]
    last = (n - 1) // size
    old = read(spark, path, size, part=name)
    new = old.select("nth", F.when(F.col("nth") == last, F.lit(record)).otherwise(F.col("record")).alias("record"))
    write(new.coalesce(1).sortWithinPartitions("nth"), path, size, "append", part=name)
