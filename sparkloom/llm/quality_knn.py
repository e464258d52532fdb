"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms are words (A-Z as a-z, hashed into ``WORD_TERMS`` places), byte trigrams of the text as it stands
(hashed into ``GRAM_TERMS`` places) and a few about repetition: words that repeat the word before, the share
of different words, the lengths of words and lines. A bounded sample of labelled documents gives the inverse
document frequencies, the mean, the truncated singular vectors of what lies off the mean, and the labelled vectors, which are broadcast
(``MAX_LABELLED`` vectors of ``DIMS`` numbers: about 1 MB, whatever the input). Every whole document is
projected, its cosines with all labelled vectors are computed in blocks, and its ``NEIGHBOURS`` nearest
vote, each with its similarity (not less than 0) as weight. A labelled text is no neighbour of its own: neighbours whose text
has the document's digest are passed over, and so are their copies.

Only the fit is bounded: at most ``MAX_LABELLED`` labelled rows that the given condition admits, the first in
the order of a digest of their identifier; of rows that share an identifier, the one with the least
text. Labels, language, source and identifier are no inputs of a score.

Defined cases: a null text counts as empty; an empty text, or one similar to no labelled one, gets the
labels' mean; without labelled rows every score is 0.5; repeated rows and null identifiers are
scored like any other; rows with null labels are not learnt from, and of several labels of one identifier the least counts; an
empty table gives an empty result; extra columns are ignored by :func:`quality_scores` and carried by :func:`accepted`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import first_by_digest, slices

MAX_LABELLED = 4096
DIMS = 64
NEIGHBOURS = 15
SLICE_BYTES = 1 << 20
BLOCK = 128
GRAM_TERMS = 1 << 12
WORD_TERMS = 1 << 11
STYLE = 32
TERMS = GRAM_TERMS + WORD_TERMS + STYLE


def remainder(id_col: Column, by: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % by


def features(texts: list[bytes]):
    """Term frequencies (one row a text, each of its three groups of length 1) as 32-bit floats."""
    import numpy as np

    from sparkloom.llm.shingles import by_text, word_hashes

    n = len(texts)
    out = np.zeros((n, TERMS), np.float32)
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if not len(joined):
        return out
    doc = np.repeat(np.arange(n), sizes)
    if len(joined) > 2:
        c = joined.astype(np.uint32)
        code = (((c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_TERMS.bit_length() + 1)
        own = doc[2:] == doc[:-2]
        grams = np.bincount(doc[2:][own] * GRAM_TERMS + code[own], minlength=n * GRAM_TERMS).reshape(n, -1)
        out[:, :GRAM_TERMS] = np.log1p(grams)
    h, d = word_hashes(texts)
    place = (h >> np.uint64(64 - WORD_TERMS.bit_length() + 1)).astype(np.int64)
    out[:, GRAM_TERMS : GRAM_TERMS + WORD_TERMS] = np.log1p(np.bincount(d * WORD_TERMS + place, minlength=n * WORD_TERMS).reshape(n, -1))
    words = np.maximum(np.bincount(d, minlength=n), 1)
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    repeated = np.bincount(d[1:][same], minlength=n) / words
    order = by_text(h, d, n)
    hs, ds = h[order], d[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])) if len(hs) else np.zeros(0, bool)
    distinct = np.bincount(ds[new], minlength=n) / np.sqrt(words * np.minimum(words, 400.0))  # longer texts repeat more
    newline = np.bincount(doc[joined == 10], minlength=n) / words
    some = np.bincount(d, minlength=n) > 0
    base = GRAM_TERMS + WORD_TERMS
    for k, x in enumerate([repeated, distinct, sizes / words / 16, newline]):
        step = np.minimum((np.clip(x, 0, 1) * 8).astype(int), 7)
        out[np.flatnonzero(some), base + 8 * k + step[some]] = 1
    for part in (slice(0, GRAM_TERMS), slice(GRAM_TERMS, base), slice(base, TERMS)):
        length = np.linalg.norm(out[:, part], axis=1, keepdims=True)
        out[:, part] /= np.where(length > 0, length, 1)
    return out


def names(texts: list[bytes]):
    """A digest of each text, by which a labelled text is told from its neighbours."""
    import numpy as np

    return np.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], "V16")


class Model:
    """Inverse document frequencies, mean, singular vectors and the labelled vectors; ``x`` is used up."""

    def __init__(self, x, y, own, seed: int = 5):
        import numpy as np

        self.y, self.own = y.astype(np.float64), own
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
        x *= self.idf
        mean = x.mean(0)
        x -= mean
        rng = np.random.Generator(np.random.PCG64(seed))
        q = rng.standard_normal((x.shape[1], min(DIMS + 16, *x.shape))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.axes = (q @ v.T)[:, :DIMS].astype(np.float32)
        self.vectors = _unit(x @ self.axes)
        self.origin = mean @ self.axes

    def project(self, x):
        """Unit vectors of feature rows; zero for rows without terms."""
        return _unit(((x * self.idf) @ self.axes - self.origin) * x.any(1)[:, None])

    def score(self, x, own):
        """Votes for the feature rows ``x`` of texts with digests ``own``."""
        import numpy as np

        out = np.empty(len(x))
        for at in range(0, len(x), BLOCK):
            sim = self.project(x[at : at + BLOCK]) @ self.vectors.T
            sim[own[at : at + BLOCK, None] == self.own] = 0
            k = min(NEIGHBOURS, sim.shape[1])
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(sim, near, 1).astype(np.float64), 0, 1)
            total = w.sum(1)
            out[at : at + BLOCK] = np.where(total > 0, (w * self.y[near]).sum(1) / np.where(total > 0, total, 1), self.y.mean())
        return out.clip(0, 1)


def _unit(v):
    import numpy as np

    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> Model | None:
    """A model of at most ``most`` of the labelled rows that ``learn`` admits."""
    import numpy as np
    import pyarrow as pa

    some = labels.where(learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    some = first_by_digest(some.where("i is not null"), most)
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(some), "i")
    rows = rows.groupBy("i").agg(F.min("t").cast("binary").alias("t"), F.first("y").alias("y"))  # at most ``most`` rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, SLICE_BYTES):
                for at in range(0, part.num_rows, BLOCK):
                    batch = part.slice(at, BLOCK)
                    texts = batch.column(1).to_pylist()
                    x = features(texts).astype(np.float16)
                    packed = [np.flatnonzero(r).astype(np.uint16).tobytes() + r[r != 0].tobytes() for r in x]
                    yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(packed, pa.binary()), pa.array([o.tobytes() for o in names(texts)], pa.binary())], names=["i", "y", "x", "own"])

    got = sorted(rows.mapInArrow(work, "i bigint, y int, x binary, own binary").collect(), key=lambda r: r["i"])
    if not got:
        return None
    x = np.zeros((len(got), TERMS), np.float32)
    for k, r in enumerate(got):
        n = len(r["x"]) // 4
        x[k, np.frombuffer(bytes(r["x"]), np.uint16, n)] = np.frombuffer(bytes(r["x"]), np.float16, n, 2 * n)
    return Model(x, np.array([r["y"] for r in got]), np.frombuffer(b"".join(bytes(r["own"]) for r in got), "V16"))


def quality_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, score, predicted."""
    import pyarrow as pa

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        m = shared.value
        for whole in batches:
            for part in slices(whole, SLICE_BYTES):
                for at in range(0, part.num_rows, BLOCK):
                    batch = part.slice(at, BLOCK)
                    texts = [t or b"" for t in batch.column(1).to_pylist()]
                    score = m.score(features(texts), names(texts)) if m is not None else np.full(batch.num_rows, 0.5)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, F.col(text_col).cast("binary").alias("t")).mapInArrow(work, f"`{id_col}` {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns, in one pass without a shuffle."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for part in slices(whole, SLICE_BYTES, place):
                for at in range(0, part.num_rows, BLOCK):
                    batch = part.slice(at, BLOCK)
                    if m is not None:
                        texts = [(t or "").encode() for t in batch.column(place).to_pylist()]
                        batch = batch.filter(pa.array(m.score(features(texts), names(texts)) >= 0.5))
                    yield batch

    return docs.mapInArrow(work, docs.schema)


def op1_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    out = quality_scores(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
