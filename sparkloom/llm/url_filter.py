"""URL filters by hashed host-suffix and path-prefix expressions (DataFrame operations only).

Each URL is expanded into (host suffix, path prefix) expressions: every suffix of its host with as
many labels as some rule's host has, with every prefix of its path whose length some rule's path has.
Expressions meet the rules on the first four bytes of their SHA-256 digest; a full digest confirms
each hit and the longest rule of a URL decides.

The expressions of one row lie in one task and are dealt by the row's number, so a frequent host makes
no frequent key; the first of them alone carries the row's host and path. The work on a URL grows with its
length and the number of different rule shapes, not with its number of labels. Rules are broadcast up to ``broadcast_rules`` of them;
beyond that both sides are dealt by (prefix, salt), the rules once for each salt.

Defined cases: hosts and paths may be of any length, in labels and in bytes; a null url or one without ``://`` has empty host and path, fits no rule and gets
the default verdict; an empty host fits no rule; repeated rows (null ids too) are judged each by
itself; an empty table gives an empty result, empty rules give the default; extra columns are
ignored. Of fitting rules of one length the one that blocks wins (the greatest verdict), then the
greatest in code-point order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import lower_ascii

#: (host, path, verdict) of the query's contract.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
PREFIX_BYTES = 4


def rules_table(spark, rules=RULES) -> DataFrame:
    """(host, path, verdict), built from literals."""
    rows = F.array(*[F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("host", "path", "verdict"), r)]) for r in rules or [("", "", "")]])
    return spark.range(1 if rules else 0).select(F.inline(rows))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 200_000, salts: int = 16) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (``host`` + ``path`` or null), verdict.

    The driver gets the distinct label counts of the rules' hosts and lengths of their paths; a URL has an expression for each
    of these counts that its host has and each of these lengths that its path reaches.
    """
    n_labels = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    r = rules.select(F.concat("host", "path").alias("rule"), F.concat_ws("\0", "host", "path").alias("x"), n_labels(F.col("host")).alias("labels"), F.length("path").alias("plen"), "verdict")
    r = r.groupBy("rule", "x", "labels", "plen").agg(F.max("verdict").alias("verdict"))  # block > allow
    r = r.withColumn("full", F.sha2("x", 256)).select("labels", "plen", F.substring("full", 1, 2 * PREFIX_BYTES).alias("short"), "full", F.struct(F.length("rule").alias("n"), "verdict", "rule").alias("says"))
    small = r.count() <= broadcast_rules
    shapes = r.agg(F.collect_set("labels").alias("labels"), F.collect_set("plen").alias("lengths")).collect()[0]
    whole = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)]).cast("array<int>")
    p = pages.select(F.col(id_col).alias("id"), F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?s).*?://([^/?#]*)([^?#]*)", 1).alias("h"), F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?s).*?://([^/?#]*)([^?#]*)", 2).alias("path"))
    p = p.withColumn("host", lower_ascii(F.col("h"))).withColumn("row", F.monotonically_increasing_id())
    counts = F.filter(whole(shapes["labels"]), lambda n: n <= n_labels(F.col("host")))
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(counts, lambda n: F.call_function("substring_index", "host", F.lit("."), -n)))
    prefixes = F.transform(F.filter(whole(shapes["lengths"]), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    both = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda x: F.sha2(F.concat_ws("\0", s, x), 256)))))
    e = p.select("row", F.struct("id", "host", "path").alias("url"), F.posexplode_outer(both).alias("at", "digest"))
    e = e.select("row", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("url")).alias("url"), "digest")
    e = e.withColumn("s", F.substring("digest", 1, 2 * PREFIX_BYTES))
    r = r.select("short", "full", "says")
    if small:
        near = e.join(F.broadcast(r), e.s == r.short, "left")
    else:
        e = e.withColumn("salt", F.col("row") % salts)
        dealt = r.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("rs"))
        near = e.join(dealt, (e.s == F.col("short")) & (e.salt == F.col("rs")), "left")
    # Rules that share a URL's short prefix only are told apart here, by the full digest.
    best = near.groupBy("row").agg(F.max(F.when(F.col("digest") == F.col("full"), F.col("says"))).alias("best"), F.first("url", ignorenulls=True).alias("url"))
    return best.select(F.col("url.id").alias(id_col), "url.host", "url.path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path,
         row_number() OVER () AS rn
  FROM p
), r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT rn, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
  FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rn
)
SELECT page_id, host, path, m.rule, coalesce(m.rv, 'allow') AS verdict FROM s LEFT JOIN m USING (rn)
"""
