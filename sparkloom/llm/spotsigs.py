"""SpotSigs document fingerprints (DataFrame operations only).

A signature is an anchor, one of the common words below, with the ``CHAIN`` content words that
follow it; a fingerprint is the set of a text's signatures (32 bits of their MD5, ascending, in
hexadecimal). A text without any anchor takes each of its words as one; a text without words has
itself as its only signature, and an empty text none. Fingerprints are compared by Jaccard
likeness, pruned by their sizes: two sets are no more alike than the smaller size over the larger.

:func:`neighbour_report` compares each text with an edited copy and with the next document; it moves
each text once, into sampled identifier ranges, to which the first document of the next range is sent
as well. :func:`near_pairs` finds near-duplicate fingerprints: partitions by set length, rare
signatures first, and pruned comparisons.

Defined cases: a null text counts as empty; null identifiers sort first; rows that share an identifier
follow each other in the order of their texts; the only row of a table is its own next; an empty
table gives an empty result; extra columns are ignored. The likeness of two empty sets is 1, of
one empty set and another 0.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import bucket_of, cut, sampled_splitters, shuffle_partitions

CHAIN = 2
#: Common words of English, French, German and Spanish.
ANCHORS = tuple(sorted(set("""
a an and are as at be by for from has he in is it its of on or that the this to was were will with
au avec dans de des du elle en est et il la le les pas pour qui que sur un une
auf das dem den der die ein eine für im ist mit nicht sich und von zu
al con del el las lo los para por se su una y
""".split())))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _hashed(x: Column) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, 8)


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the ascending distinct signature hashes of ``text_col`` (an array of strings)."""
    w, c, at = f"__{out}_w", f"__{out}_c", f"__{out}_a"
    df = df.withColumn(w, _words(F.col(text_col)))
    df = df.withColumn(c, F.filter(w, lambda x: ~x.isin(*ANCHORS)))
    df = df.withColumn(at, F.filter(F.transform(w, lambda x, i: F.when(x.isin(*ANCHORS), i)), lambda i: i.isNotNull()))
    # The k-th anchor stands at word i, so i - k content words come before it.
    spots = F.transform(at, lambda i, k: F.when(i - k < F.size(c), F.concat_ws(" ", F.get(F.col(w), i), F.array_join(F.slice(F.col(c), i - k + 1, F.lit(CHAIN)), " "))))
    spots = F.filter(spots, lambda x: x.isNotNull())
    every = F.transform(F.col(w), lambda x, i: F.array_join(F.slice(F.col(w), i + 1, F.lit(CHAIN + 1)), " "))
    df = df.withColumn(f"__{out}_s", spots)
    sigs = F.when(F.size(f"__{out}_s") > 0, F.col(f"__{out}_s")).when(F.size(w) > 0, every).when(F.col(text_col) != "", F.array(F.col(text_col))).otherwise(F.array().cast("array<string>"))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.transform(sigs, _hashed)))).drop(w, c, at, f"__{out}_s")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two fingerprints; 0 where their sizes alone put it below ``at_least``."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    value = both.cast("double") / (n + m - both)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when(F.least(n, m) < F.greatest(n, m) * F.lit(at_least), F.lit(0.0)).when(F.least(n, m) == 0, F.lit(0.0)).otherwise(value)


def neighbour_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # A missing identifier is told from all others by its flag and stands before them.
    src = src.select(F.struct(F.col("i").isNotNull().alias("is"), F.coalesce("i", F.lit(0).cast("long")).alias("i")).alias("i"), "t")
    schema = T.StructType([T.StructField("i", src.schema["i"].dataType)])
    first = src.agg(F.min("i")).collect()[0][0]
    if first is None:
        first = (False, 0)
    splitters = [r for r in sampled_splitters(src, {"i": F.col("i")}, parts * 8) if tuple(r["i"]) > tuple(first)]
    last = len(splitters)
    src = src.withColumn("b", bucket_of(splitters, {"i": F.col("i")}, schema))
    # A splitter is a document's own identifier: the first of a range is also sent to the range before.
    cuts = F.from_json(F.lit(json.dumps([r["i"].asDict() for r in splitters])), T.ArrayType(schema["i"].dataType))
    place = lambda b, wrap, ghost: F.struct(b.alias("b"), F.lit(wrap).alias("wrap"), F.lit(ghost).alias("ghost"))
    lowest = F.struct(F.lit(first[0]).alias("is"), F.lit(first[1]).cast("long").alias("i"))
    copies = F.array(place(F.col("b"), 0, False), F.when(F.get(cuts, F.col("b") - 1) == F.col("i"), place(F.col("b") - 1, 0, True)), F.when(F.col("i") == lowest, place(F.lit(last), 1, True)))
    rows = src.select("i", "t", F.inline(F.filter(copies, lambda x: x.isNotNull()))).repartition(parts, "b")
    rows = with_fingerprint(rows, "t", "fp").withColumn("n", F.length("t"))
    w = Window.partitionBy("b").orderBy("wrap", "i", "t")
    rows = rows.withColumn("nt", F.lead("t").over(w)).withColumn("nfp", F.lead("fp").over(w)).where("not ghost")
    k = F.floor(F.col("n") / 4).cast("int")
    rows = rows.withColumn("e", F.concat(F.expr("substring(t, 1, n - cast(floor(n / 4) as int))"), F.col("nt").substr(F.lit(1), k)))
    rows = with_fingerprint(rows, "e", "efp")
    return rows.select(
        F.when(F.col("i.is"), F.col("i.i")).cast(kind).alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("e", 256).alias("edited_sha256"),
        F.array_join("fp", " ").alias("fingerprint"),
        F.array_join("efp", " ").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of different fingerprints at least ``percent`` % alike, each named by its
    smallest identifier, a < b; members (id, class) tells each row's fingerprint's name. Exact; copies are never paired.

    A set goes, for each signature of its prefix (its rarest, enough that two sets this alike must share
    one), to the partition of its length and to that of the shorter sets it can still be like.
    """
    fps = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), "t", "fp")
    fps = cut(fps.select("id", "fp", F.sha2(F.array_join("fp", " "), 256).alias("h")))
    names = fps.groupBy("h").agg(F.min("id").alias("class"), F.first("fp").alias("fp"))
    members = fps.select("id", "h").join(names.select("h", "class"), "h").select("id", "class")
    sets = cut(names.where(F.size("fp") > 0).select("class", "fp", F.size("fp").alias("n")))
    sig = sets.select("class", "n", F.explode("fp").alias("sig"))
    df = sig.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = sig.join(df, "sig").withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("df", "sig")))
    prefix = cut(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("df > 1").select("class", "n", "sig"))
    step = F.log(F.lit(100 / percent))
    band = lambda n: F.floor(F.log(n) / step)
    lo = prefix.select(F.col("class").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(band(F.col("n")), band(F.col("n")) - 1)).alias("band"))
    hi = prefix.select(F.col("class").alias("b"), F.col("n").alias("nb"), "sig", band(F.col("n")).alias("band"))
    fits = ((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))) & (100 * F.col("nb") >= percent * F.col("na"))
    found = lo.join(hi, ["sig", "band"]).where(fits).select("a", "b").distinct()
    full = found.join(sets.select(F.col("class").alias("a"), F.col("fp").alias("fa")), "a").join(sets.select(F.col("class").alias("b"), F.col("fp").alias("fb")), "b")
    full = full.withColumn("likeness", likeness(F.col("fa"), F.col("fb"), percent / 100)).where(100 * F.size(F.array_intersect("fa", "fb")) >= percent * F.size(F.array_union("fa", "fb")))
    return full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members


def op7_spotsigs(spark, sf_dir: str) -> DataFrame:
    return neighbour_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _fp_sql(text: str) -> str:
    words = ", ".join(f"'{x}'" for x in ANCHORS)
    return f"""
      SELECT rn, list_sort(list_distinct(list_transform(
        CASE WHEN len(spots) > 0 THEN spots WHEN len(w) > 0 THEN everyone WHEN t <> '' THEN [t] ELSE [] END, lambda x: substr(md5(x), 1, 8)))) AS fp
      FROM (
        SELECT *, list_filter(list_transform(a, lambda i, k: CASE WHEN i - k + 1 < len(c) THEN w[i + 1] || ' ' || list_aggregate(c[i - k + 2 : i - k + 1 + {CHAIN}], 'string_agg', ' ') END), lambda x: x IS NOT NULL) AS spots,
          list_transform(w, lambda x, i: list_aggregate(w[i : i + {CHAIN}], 'string_agg', ' ')) AS everyone
        FROM (
          SELECT *, list_filter(w, lambda x: NOT list_contains(anchors, x)) AS c,
            list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(anchors, x) THEN i - 1 END), lambda i: i IS NOT NULL) AS a
          FROM (SELECT rn, {text} AS t, list_filter(string_split_regex(lower({text}), '[^\\pL\\pN]+'), lambda x: x <> '') AS w, [{words}] AS anchors FROM e)))
    """


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rn, count(*) OVER () AS total FROM documents
), p AS (
  SELECT d.*, length(d.t) AS n, n.t AS nt, n.rn AS nrn FROM d JOIN d n ON n.rn = d.rn % d.total + 1
), e AS (
  SELECT *, substr(t, 1, n - n // 4) || substr(nt, 1, n // 4) AS et FROM p
), f AS ({_fp_sql('t')}), g AS ({_fp_sql('et')})
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.et) AS edited_sha256,
  coalesce(list_aggregate(f.fp, 'string_agg', ' '), '') AS fingerprint, coalesce(list_aggregate(g.fp, 'string_agg', ' '), '') AS edited_fingerprint,
  CASE WHEN len(f.fp) = 0 AND len(g.fp) = 0 THEN 1.0 WHEN len(f.fp) = 0 OR len(g.fp) = 0 THEN 0.0
    ELSE len(list_intersect(f.fp, g.fp))::DOUBLE / (len(f.fp) + len(g.fp) - len(list_intersect(f.fp, g.fp))) END AS near_edited,
  CASE WHEN len(f.fp) = 0 AND len(x.fp) = 0 THEN 1.0 WHEN len(f.fp) = 0 OR len(x.fp) = 0 THEN 0.0
    ELSE len(list_intersect(f.fp, x.fp))::DOUBLE / (len(f.fp) + len(x.fp) - len(list_intersect(f.fp, x.fp))) END AS near_next
FROM e JOIN f ON f.rn = e.rn JOIN g ON g.rn = e.rn JOIN f x ON x.rn = e.nrn
"""
