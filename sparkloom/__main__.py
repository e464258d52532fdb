"""python -m sparkloom FILE [-l LANGUAGE] [-n STEPS] [--ir-only | --cfg-only | --mermaid] [-v]"""

from __future__ import annotations

import argparse

from sparkloom.api import Analysis, Replay, lower_sources


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="sparkloom")
    args.add_argument("file")
    args.add_argument("-l", "--language", default="python")
    args.add_argument("-n", "--steps", type=int, default=100)
    args.add_argument("-v", "--verbose", action="store_true")
    args.add_argument("--ir-only", action="store_true")
    args.add_argument("--cfg-only", action="store_true")
    args.add_argument("--mermaid", action="store_true")
    a = args.parse_args(argv)
    with open(a.file, encoding="utf-8") as f:
        source = f.read()
    replay = Replay(source, a.language, a.steps)
    if a.ir_only:
        print("\n".join(replay.text()))
        return 0
    if a.cfg_only or a.mermaid:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        g = Analysis(lower_sources(spark.createDataFrame([(1, a.language, source)], "program_id bigint, language string, source string")))
        lines = sorted(f"    {r.src} --> {r.dst}" if a.mermaid else f"{r.src} -> {r.dst}" for r in g.edges.collect())
        print("\n".join((["flowchart TD"] if a.mermaid else []) + lines))
        return 0
    for step, pc, op, variables in replay.trace if a.verbose else replay.trace[-1:]:
        print(step, pc, op, variables)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
