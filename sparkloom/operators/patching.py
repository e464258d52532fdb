"""Many replacements in one text, applied in one pass.

Spans are places of code points [start, stop) of the old text. They are taken in the order of (start, stop, replacement); a span that
begins before the end of any earlier one, kept or not, is refused as ``overlap``, one that is not inside the text, backwards or without a
number or replacement as ``range``. Empty spans insert, several at one place in their order. New places are old ones and the sum of the
shifts of all kept spans before, so they are known without the text; the text is then put together piece by piece, once.

Rows of one text lie in one task with its spans; a text without spans stays as it is, a null text has no places, spans of unknown texts are
refused as ``range``. Identifiers must be unique; null ones have no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, start, stop, replacement, status, new_start) of spans (id, start, stop, replacement); texts (id, text). new_start is null for refused ones."""
    sizes = texts.select("id", F.length("text").alias("size"))
    s = spans.select("id", "start", "stop", "replacement").join(sizes, "id", "left")
    inside = F.coalesce((F.col("start") >= 0) & (F.col("stop") >= F.col("start")) & (F.col("stop") <= F.col("size")) & F.col("replacement").isNotNull(), F.lit(False))
    s = s.withColumn("inside", inside)
    earlier = Window.partitionBy("id", "inside").orderBy("start", "stop", "replacement").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("status", F.when(~F.col("inside"), "range").when(F.col("start") < F.max("stop").over(earlier), "overlap").otherwise("kept"))
    shift = F.when(F.col("status") == "kept", F.length("replacement") - (F.col("stop") - F.col("start"))).otherwise(0)
    s = s.withColumn("moved", F.coalesce(F.sum(shift).over(earlier), F.lit(0)))
    return s.select("id", "start", "stop", "replacement", "status", F.when(F.col("status") == "kept", F.col("start") + F.col("moved")).alias("new_start"))


def patched(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text, kept, refused) of every row of ``texts``, with the spans applied that :func:`judged` keeps."""
    import pyarrow as pa

    j = judged(texts, spans).where("id is not null")
    kept = F.collect_list(F.when(F.col("status") == "kept", F.struct("new_start", "start", "stop", "replacement")))
    lists = j.groupBy("id").agg(F.array_sort(kept).alias("spans"), F.count(F.when(F.col("status") != "kept", 1)).alias("refused"))
    both = texts.select("id", "text").join(lists, "id", "left").select("id", "text", F.coalesce("refused", F.lit(0)).cast("long").alias("refused"), "spans.start", "spans.stop", "spans.replacement")
    kind = texts.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for text, starts, stops, words in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "stop", "replacement"))):
                n.append(len(starts or ()))
                if text is None or not starts:
                    out.append(text)
                    continue
                pieces = [x for a, b, w in zip([0, *stops], starts, words) for x in (text[a:b], w)]
                out.append("".join(pieces) + text[stops[-1] :])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string()), pa.array(n, pa.int64()), batch.column("refused")], names=["id", "text", "kept", "refused"])

    return both.mapInArrow(work, f"id {kind}, text string, kept bigint, refused bigint")
