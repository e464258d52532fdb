"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are letter 1-, 2- and 3-grams (lower case; everything else is one space), hashed into
``FEATURES`` places, as logarithmic term frequency times inverse document frequency, of length 1. The
weights are trained on the driver by follow-the-regularised-leader (proximal, a learning rate for each
weight) with elastic-net penalties on a bounded sample: the first ``MAX_ROWS`` admitted rows in the
order of a digest of their identifier (of rows that share one, the least text). A fifth of the sample is held back to fit the temperature
that the scores are divided by. Every whole text is then predicted where it lies; nothing is shuffled.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, and so is every text where
nothing could be learnt; rows with null language are not learnt from; ties go to the first language in
code-point order; null identifiers and repeated rows are predicted like any other; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import first_by_digest, slices

FEATURES = 1 << 13
MAX_ROWS = 4000
SLICE_BYTES = 1 << 20
BLOCK = 128
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2e-4, 1e-4
EPOCHS, BATCH = 6, 32
_LETTER = None


def _letters():
    """Whether each code point is a letter."""
    import sys

    import numpy as np

    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)], bool)
    return _LETTER


def ngram_counts(texts: list[str]):
    """(counts of hashed n-grams, one row a text; whether each text has a letter)."""
    import numpy as np

    n = len(texts)
    lowered = [t.lower() for t in texts]
    joined = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), [len(t) + 2 for t in lowered])
    letter = _letters()[joined]
    c = np.where(letter, joined, np.uint32(32))
    has = np.bincount(doc[letter], minlength=n) > 0
    counts = np.zeros(n * FEATURES, np.int64)
    mask = np.uint32(FEATURES - 1)
    h = np.zeros(len(c), np.uint32)
    for k in range(3):
        m = len(c) - k
        h = (h[:m] * np.uint32(0x01000193)) ^ (c[k:] * np.uint32(0x9E3779B1))
        code = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(12) & mask
        ok = (doc[:m] == doc[k:]) & (letter[:m] | letter[k:])
        counts += np.bincount(doc[:m][ok] * FEATURES + code[ok], minlength=n * FEATURES)
    return counts.reshape(n, FEATURES), has


class Model:
    """Languages, inverse document frequencies, weights and temperature."""

    def __init__(self, counts, langs: list[str], hold, seed: int = 3):
        import numpy as np

        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(x) for x in langs])
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        x = self.vectors(counts)
        train, held = np.flatnonzero(~hold), np.flatnonzero(hold)
        if not len(train):
            train = held
        rng = np.random.Generator(np.random.PCG64(seed))
        d, k = x.shape[1] + 1, len(self.langs)
        z, s, w = np.zeros((d, k)), np.zeros((d, k)), np.zeros((d, k))
        for _ in range(EPOCHS):
            order = rng.permutation(train)
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                b = np.hstack([x[part], np.ones((len(part), 1), np.float32)])
                z, s, w = leader_step(b, y[part], z, s, w, L1 * len(train), L2 * len(train))
        self.w = w.astype(np.float32)
        self.temperature = 1.0
        if len(held) and k > 1:
            logits = self._logits(x[held])
            loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
            self.temperature = float(min(np.exp(np.linspace(np.log(0.05), np.log(10), 107)), key=loss))

    def vectors(self, counts):
        import numpy as np

        x = np.log1p(counts.astype(np.float32)) * self.idf
        length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return x / np.where(length > 0, length, 1)

    def _logits(self, x):
        return x @ self.w[:-1] + self.w[-1]

    def predict(self, counts):
        p = _softmax(self._logits(self.vectors(counts)).astype("float64") / self.temperature)
        best = p.argmax(1)
        return [self.langs[i] for i in best], p.max(1).clip(0, 1)


def leader_step(b, y, z, s, w, l1: float, l2: float):
    """Weights that lead after one more batch: (z, s, w) with the sums of adjusted gradients and of squared gradients."""
    import numpy as np

    p = _softmax(b @ w)
    p[np.arange(len(y)), y] -= 1
    g = b.T @ p
    rate = (np.sqrt(s + g * g) - np.sqrt(s)) / ALPHA
    z = z + g - rate * w
    s = s + g * g
    return z, s, np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(s)) / ALPHA + l2))


def _softmax(a):
    import numpy as np

    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_ROWS) -> Model | None:
    """A model of at most ``most`` rows with a language that ``learn`` admits."""
    import numpy as np
    import pyarrow as pa

    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    some = first_by_digest(rows.select("i").where("i is not null").distinct(), most)
    rows = rows.join(F.broadcast(some), "i").groupBy("i").agg(F.min(F.struct("t", "l")).alias("r"))
    rows = rows.select("i", "r.t", "r.l", (F.crc32(F.concat(F.lit("hold"), F.col("i").cast("string")).cast("binary")) % 5 == 0).alias("h"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, SLICE_BYTES):
                for at in range(0, part.num_rows, BLOCK):
                    batch = part.slice(at, BLOCK)
                    counts, has = ngram_counts(batch.column(1).to_pylist())
                    packed = [np.flatnonzero(r).astype(np.uint16).tobytes() + r[r != 0].astype(np.uint32).tobytes() if ok else None for r, ok in zip(counts, has)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3), pa.array(packed, pa.binary())], names=["i", "l", "h", "x"])

    got = [r for r in rows.mapInArrow(work, "i bigint, l string, h boolean, x binary").collect() if r["x"] is not None]
    got.sort(key=lambda r: r["i"])
    if not got:
        return None
    counts = np.zeros((len(got), FEATURES), np.uint32)
    for k, r in enumerate(got):
        n = len(r["x"]) // 6
        counts[k, np.frombuffer(bytes(r["x"]), np.uint16, n)] = np.frombuffer(bytes(r["x"]), np.uint32, n, 2 * n)
    return Model(counts, [r["l"] for r in got], np.array([r["h"] for r in got]))


def predict_languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, lang_pred, score."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for part in slices(whole, SLICE_BYTES):
                for at in range(0, part.num_rows, BLOCK):
                    batch = part.slice(at, BLOCK)
                    langs, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
                    if m is not None:
                        counts, has = ngram_counts([t or "" for t in batch.column(1).to_pylist()])
                        for j, (lang, p) in enumerate(zip(*m.predict(counts))):
                            if has[j]:
                                langs[j], score[j] = lang, float(p)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, lang_pred string, score double")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = predict_languages(docs, fit(docs, rest != 2))
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
