"""Suspended programs as streaming state, and streaming statistics of instructions.

Each key runs its own copy of a program; SUSPEND parks the machine in the key's state until the next value comes. State
is one pickled machine a key, kept by the state store and so recovered with the query's checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resume_programs(values: DataFrame, source: str, most: int = 10_000) -> DataFrame:
    """values: a stream (key bigint, ord bigint, value bigint). Gives (key, resumed, waiting): values taken so far and what the program now yields."""

    def step(key, batches: Iterator, state):
        import pandas as pd

        from sparkloom.frontends.python_ast import lower
        from sparkloom.vm.machine import Machine

        if state.exists:
            n, blob = state.get
            m = pickle.loads(blob)
        else:
            n, m = 0, Machine(lower(source)).run(most)
        rows = pd.concat(list(batches)).sort_values("ord")
        for v in rows["value"].tolist():
            if m.waiting is None:
                break
            m.resume(v, most)
            n += 1
        state.update((n, pickle.dumps(m)))
        out = m.waiting[1] if m.waiting is not None else None
        yield pd.DataFrame({"key": [key[0]], "resumed": [n], "waiting": [str(m.plain(out))]})

    return values.groupBy("key").applyInPandasWithState(step, "key bigint, resumed bigint, waiting string", "n bigint, machine binary", "update", "NoTimeout")


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n) of a stream: events a window, rows later than the watermark dropped by the engine."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives its rows as a table in ``folder``, with its checkpoint beside it."""
    spark = stream.sparkSession
    out = f"{folder}/rows"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(out)
