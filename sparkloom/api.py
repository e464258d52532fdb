"""The engine's public functions: from sources to instructions, graphs, analyses, results and replayed steps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.frontends import lower as _lower
from sparkloom.operators import cfg, dataflow, inference, link, registry, summaries
from sparkloom.plans import fixpoint
from sparkloom.sources import imports
from sparkloom.vm import tables
from sparkloom.vm.machine import Machine


def lower_sources(sources: DataFrame) -> DataFrame:
    """The instruction table of (program_id, language, source) rows."""
    spark = sources.sparkSession
    tables.register(spark)
    sources.select("program_id", "language", "source").createOrReplaceTempView("sparkloom_sources")
    return spark.sql("SELECT program_id, r.* FROM sparkloom_sources s, LATERAL lower_source(s.source, s.language) r")


def lower_directory(spark: SparkSession, root: str, language: str) -> tuple[DataFrame, DataFrame]:
    """(programs, instructions) of all files of a language below a folder; program_id is a digest of the path."""
    files = imports.scan(spark, root, language).select(F.xxhash64("path").alias("program_id"), "path", F.lit(language).alias("language"), "source")
    return files, lower_sources(files)


@dataclass
class Analysis:
    """All relations of a set of programs, each computed once, when it is first asked for, and kept in the shared folder."""

    instr: DataFrame
    _made: dict = field(default_factory=dict)

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = fixpoint.checkpointed(make())
        return self._made[name]

    @property
    def placed(self) -> DataFrame:
        return self._once("placed", lambda: cfg.placed(self.instr))

    @property
    def blocks(self) -> DataFrame:
        return self._once("blocks", lambda: cfg.blocks(self.placed))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: cfg.edges(self.blocks))

    @property
    def reaching(self) -> DataFrame:
        return self._once("reaching", lambda: dataflow.reaching(dataflow.gen(cfg.writes(self.placed)), self.edges))

    @property
    def def_use(self) -> DataFrame:
        return self._once("def_use", lambda: dataflow.def_use(cfg.writes(self.placed), cfg.reads(self.placed), self.reaching))

    @property
    def dependencies(self) -> DataFrame:
        def make():
            flow = dataflow.produced_from(cfg.writes(self.placed), cfg.reads(self.placed))
            return fixpoint.closure_by_key(dataflow.raw_dependencies(self.placed, dataflow.named_sources(flow)), "program_id")

        return self._once("dependencies", make)

    @property
    def functions(self) -> DataFrame:
        return self._once("functions", lambda: registry.functions(self.placed))

    @property
    def parameters(self) -> DataFrame:
        return self._once("parameters", lambda: registry.parameters(self.placed))

    @property
    def call_graph(self) -> DataFrame:
        return self._once("call_graph", lambda: registry.call_graph(self.placed))

    @property
    def summary(self) -> DataFrame:
        """Flows from parameters to results, fields and through pointers, of every function."""
        return self._once("summary", lambda: summaries.summary(self.placed))

    @property
    def flows(self) -> DataFrame:
        """All flows of whole programs, closed."""
        return self._once("flows", lambda: summaries.whole_program(self.placed, self.summary)[1])

    @property
    def report(self) -> DataFrame:
        """Callers, callees and numbers of flows of every function."""
        return self._once("report", lambda: summaries.report(self.placed, self.summary))

    def types(self, seeds: dict[str, str] | None = None) -> DataFrame:
        return inference.infer(self.instr, seeds or {})


def analyze(sources: DataFrame) -> Analysis:
    return Analysis(lower_sources(sources))


def link_project(sources: DataFrame) -> DataFrame:
    """Modules (project, program_id, place, prefix, language, source), dependencies at lower places, as one instruction table a project."""
    spark = sources.sparkSession
    tables.register(spark)
    sources.select("program_id", "language", "source").createOrReplaceTempView("sparkloom_project")
    code = spark.sql("SELECT program_id, r.* FROM sparkloom_project s, LATERAL lower_code(s.source, s.language) r")
    return link.link_modules(fixpoint.checkpointed(code), sources.select("project", "program_id", "place", "prefix"))


def run_project(sources: DataFrame, variable: str, entry: str | None = None, most: int = 20_000) -> DataFrame:
    """(program_id, answer, result, finished): each project linked and run, first its top levels, then ``entry``."""
    return tables.run_table(link_project(sources), variable, entry, most)


def run(source: str, language: str = "python", most: int = 100) -> Machine:
    return Machine(_lower(source, language)).run(most)


class Replay:
    """A recorded run: step forward and back over its states."""

    def __init__(self, source: str, language: str = "python", most: int = 300):
        self.code = _lower(source, language)
        self.trace: list = []
        self.machine = Machine(self.code).run(most, self.trace)
        self.at = 0

    def step(self, n: int = 1) -> list:
        self.at = max(0, min(len(self.trace), self.at + n))
        return self.trace[max(0, self.at - n) : self.at]

    def run_to_end(self) -> list:
        return self.step(len(self.trace))

    def state(self) -> dict:
        return self.trace[self.at - 1][3] if self.at else {}

    def text(self) -> list[str]:
        out = []
        for op, reg, ops, label, targets in self.code:
            body = " ".join([op.lower(), *map(str, ops)]) + (f" -> {', '.join(targets)}" if targets else "")
            out.append(f"{label}:" if op == "LABEL" else f"{reg} = {body}" if reg else body)
        return out
