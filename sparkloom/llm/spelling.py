"""Spelling variants: words one edit apart, found by bands of a letter-parity mask (DataFrame operations only).

A word's mask holds, for each letter, whether it occurs an odd number of times. One inserted or
deleted letter flips one bit of it, a replaced letter two bits or none. The mask is cut into three
bands, so near words of one length share a band, and near words whose lengths differ by one share
two. Words meet on (lengths of the pair, equal bands, the half of the word that the edit left
alone); a pair that meets several times is kept at the first of its meetings, and the edit distance
decides inside the join, so that only near pairs leave it.

A word has no more near words than there are strings one edit away, so no word is a hot key;
occurrences are counted map-side before they are shuffled. A form has at least ``ratio`` times the
word's occurrences, so chains of forms are short; roots are found by doubling.

Defined cases: a null or empty text has no words; a null identifier counts as an empty string in the
digest; repeated rows count each; a long word is compared as a whole; of near words with equal n the
least in code-point order is the form; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, lower_ascii

#: A run's characters: letters of ASCII and the upper half of the Latin-1 letters with its two signs.
LETTERS = "A-Za-zÀ-ÿ"
BITS = 63
#: A word is cut into so many parts; one edit touches one of them.
PARTS = 3
#: The bits of each of the three bands: every third one, so that the letters a to z spread evenly.
BANDS = tuple(sum(1 << b for b in range(BITS) if b % 3 == j) for j in range(3))


def occurrences(docs: DataFrame, shortest: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """(word): each run of ``shortest`` letters or more, with one code point deleted where ``every`` divides the crc32 of ``id:run`` (0: never)."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0)))
    r = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), run.alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    r = r.select("i", F.when(ascii_only, F.lower("run")).otherwise(lower_ascii(F.col("run"))).alias("run"))
    if not every:
        return r.select(F.col("run").alias("word"))
    r = r.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return r.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def parity_mask(word: Column) -> Column:
    """One bit for each letter (its code point modulo ``BITS``) that occurs an odd number of times."""
    bits = F.transform(F.split(word, ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseXOR(b))


def _at(shorter: Column, part: int) -> Column:
    """Where a part of words begins, the shorter of two being ``shorter`` letters long."""
    return F.floor(shorter * part / PARTS).cast("int")


def _meetings(words: DataFrame, shorter: Column, equal: tuple[tuple[int, ...], ...]) -> DataFrame:
    """``words`` once for each way to meet a near word, the shorter of the two ``shorter`` letters long: (way, key, word, n, mask).

    A way says which of ``equal`` bands are the same and which part has the edit, so that all before and behind it is the same.
    """
    word = F.col("word")
    sides = []
    for p in range(PARTS):
        behind = shorter - _at(shorter, p + 1)
        sides.append(F.xxhash64(shorter, F.lit(p), word.substr(F.lit(1), _at(shorter, p)), word.substr(F.length(word) - behind + 1, behind)).alias(f"side{p}"))
    words = words.select("word", "n", "mask", *sides)  # by itself, so that the ways below stay small code
    ways = []
    for k, same in enumerate(equal):
        bits = F.col("mask").bitwiseAND(F.lit(sum(BANDS[j] for j in same)))
        ways += [F.struct(F.lit(PARTS * k + p).cast("byte").alias("way"), F.xxhash64(f"side{p}", bits).alias("key")) for p in range(PARTS)]
    return words.select("word", "n", "mask", F.inline(F.array(*ways)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every two of ``words`` (word, n; distinct words) that differ by one inserted, deleted or replaced code point, once."""
    words = words.select("word", "n", parity_mask(F.col("word")).alias("mask"))
    size = F.length("word")
    side = lambda df, x: df.select("way", "key", *[F.col(c).alias(c[0] + x) for c in ("word", "n", "mask")])
    changed = F.col("ma").bitwiseXOR(F.col("mb"))
    near = F.levenshtein(F.col("wa"), F.col("wb"), 1) == 1
    differ = [changed.bitwiseAND(F.lit(b)) != 0 for b in BANDS]
    # One of the three bands is the same: the first such band counts. The part of a replaced letter is the only one that differs.
    first_band = (F.col("way") < PARTS) | (differ[0] & ((F.col("way") < 2 * PARTS) | differ[1]))
    same = _meetings(words, size, ((0,), (1,), (2,)))
    replaced = side(same, "a").join(side(same, "b"), ["way", "key"]).where((F.col("wa") < F.col("wb")) & (F.bit_count(changed) <= 2) & first_band & near)
    # Two bands are the same and one is not; a letter inserted into a run of its own, or between parts, can be in two parts: the first one counts.
    two = ((0, 1), (0, 2), (1, 2))
    n = F.length("wa")
    ends = lambda p: F.col("wa").substr(_at(n, p) + 1, n) == F.col("wb").substr(_at(n, p) + 2, n + 1)
    first_part = F.col("way") % PARTS == 0
    for p in range(1, PARTS):
        first_part = first_part | ((F.col("way") % PARTS == p) & ~ends(p))
    short, long_ = _meetings(words, size, two), _meetings(words, size - 1, two)
    inserted = side(short, "a").join(side(long_, "b"), ["way", "key"]).where((F.length("wb") == n + 1) & (F.bit_count(changed) == 1) & near & first_part)
    out = [F.col("wa").alias("a"), "na", F.col("wb").alias("b"), "nb"]
    return replaced.select(*out).union(inserted.select(*out))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of ``forms`` (word, form): the last word of its chain. Every round doubles the steps taken."""
    now = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not now.where("open").isEmpty():
        step = now.select(F.col("word").alias("w2"), F.col("root").alias("r2"))
        now = cut(now.join(step, now.root == step.w2, "left").select("word", F.coalesce("r2", "root").alias("root"), F.col("r2").isNotNull().alias("open")))
    return now.select("word", "root")


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least ``shortest`` code points and ``least`` occurrences."""
    words = occurrences(docs, shortest, every, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = cut(words.where((F.col("n") >= least) & (F.length("word") >= shortest)))
    pairs = near_pairs(words)
    seen = lambda w, m, o: F.struct(F.col(w).alias("w"), F.struct((-F.col(m)).alias("m"), F.col(o).alias("o")).alias("best"))
    both = pairs.select(F.inline(F.array(seen("a", "nb", "b"), seen("b", "na", "a"))))
    near = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    out = words.join(near, F.col("word") == F.col("w"), "left").withColumn("is", -F.col("best.m") >= ratio * F.col("n"))
    out = cut(out.select("word", F.when(F.col("is"), F.col("best.o")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is"), -F.col("best.m")).alias("form_n")))
    last = roots(out.where("form is not null")).select(F.col("word").alias("w"), "root")
    return out.join(last, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
