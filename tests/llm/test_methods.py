"""The operators' methods, each against a plain version of it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid, quality_knn, spotsigs, url_filter


def test_votes_by_plain_loop():
    import numpy as np

    rng = random.Random(2)
    good = [" ".join(rng.choice("river stone walk green morning".split()) for _ in range(30)) for _ in range(20)]
    bad = [" ".join(rng.choice("BUY!! NOW!! $$$ | click".split()) for _ in range(30)) for _ in range(20)]
    texts = [t.encode() for t in good + bad]
    y = np.array([1] * 20 + [0] * 20)
    model = quality_knn.Model(quality_knn.features(texts), y, quality_knn.names(texts))
    asked = [*texts[:3], *texts[-3:], b"river BUY!! stone", b"", b"green click"]
    x = quality_knn.features(asked)
    got = model.score(x, quality_knn.names(asked))
    for text, row, score in zip(asked, x, got):
        v = [sum(float(row[j]) * float(model.idf[j]) * float(model.axes[j, k]) for j in np.flatnonzero(row)) - float(model.origin[k]) if text else 0.0 for k in range(model.axes.shape[1])]
        size = math.sqrt(sum(a * a for a in v)) or 1
        sims = sorted(((sum(a * float(b) for a, b in zip(v, u)) / size, float(q)) for t, u, q in zip(texts, model.vectors, y) if t != text), reverse=True)[: quality_knn.NEIGHBOURS]
        weights = [max(s, 0) for s, _ in sims]
        want = sum(w * q for w, (_, q) in zip(weights, sims)) / sum(weights) if sum(weights) > 0 else y.mean()
        assert score == pytest.approx(want, abs=2e-3)
    assert got[0] > 0.9 and got[3] < 0.1


def test_scores_see_words_and_letters(spark):
    rows = [(i, f"{w} {w}s and the {w} of {i}", q) for i, (w, q) in enumerate([("cat", 1), ("dog", 0)] * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality_knn.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"), F.lit(True))
    scores = quality_knn.quality_scores(spark.createDataFrame([(1, "cat cats and the cat of 5"), (2, "dog dogs and the dog of 5")], "doc_id bigint, text string"), model).collect()
    assert [r.predicted for r in sorted(scores)] == [1, 0]


def test_repeated_identifiers_are_learnt_from_once(spark):
    rows = [(i % 5, f"text {i} of some words", "en" if i % 5 % 2 else "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(1, 0)], "doc_id bigint, quality int")
    model = quality_knn.fit(docs, labels, F.lit(True), most=4)
    assert len(model.y) == 4 and quality_knn.fit(docs.repartition(3), labels, F.lit(True), most=4).vectors.tolist() == model.vectors.tolist()
    assert langid.fit(docs, F.lit(True), most=4).w.tolist() == langid.fit(docs.repartition(3), F.lit(True), most=4).w.tolist()


def test_letters_of_all_planes(spark):
    docs = spark.createDataFrame([(i, chr(0x20000) * 20 if i % 2 else "plain words here", "zh" if i % 2 else "en") for i in range(40)] + [(40, "12 \U0001f600 --", "en")], "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in langid.predict_languages(docs, langid.fit(docs, F.lit(True))).collect()}
    assert all(out[i].lang_pred == ("zh" if i % 2 else "en") and out[i].score > 0.5 for i in range(40)) and out[40].lang_pred == "und"


def test_leader_step_by_plain_loop():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    z = s = w = np.zeros((5, 3))
    pz, ps, pw = ([[0.0] * 3 for _ in range(5)] for _ in range(3))
    for _ in range(6):
        x, y = rng.random((4, 5)), rng.integers(0, 3, 4)
        z, s, w = langid.leader_step(x, y, z, s, w, 0.05, 0.1)
        g = [[0.0] * 3 for _ in range(5)]
        for row, label in zip(x, y):
            e = [math.exp(sum(row[j] * pw[j][k] for j in range(5))) for k in range(3)]
            for j in range(5):
                for k in range(3):
                    g[j][k] += row[j] * (e[k] / sum(e) - (k == label))
        for j in range(5):
            for k in range(3):
                pz[j][k] += g[j][k] - (math.sqrt(ps[j][k] + g[j][k] ** 2) - math.sqrt(ps[j][k])) / langid.ALPHA * pw[j][k]
                ps[j][k] += g[j][k] ** 2
                a = pz[j][k]
                pw[j][k] = 0.0 if abs(a) <= 0.05 else -(a - math.copysign(0.05, a)) / ((langid.BETA + math.sqrt(ps[j][k])) / langid.ALPHA + 0.1)
        assert np.allclose(w, pw) and np.allclose(z, pz)
    assert (w == 0).any() or (w != 0).any()


@pytest.mark.parametrize("bound", [1000, 0])
def test_rules_that_tie_and_prefixes_that_clash(spark, monkeypatch, bound):
    rules = url_filter.rules_table(spark, [("com", "/aaaa", "allow"), ("x.com", "/aa", "block"), ("net", "/bb", "block"), ("y.net", "", "allow")])
    urls = ["http://x.com/aaaa", "http://y.net/bb/" + "c" * 50_000, "http://" + "a." * 300 + "net/bb", "http://com/b"]
    pages = spark.createDataFrame([(k, u, "x", "y", 0) for k, u in enumerate(urls)], "page_id bigint, url string, rule string, host string, row int")
    want = [("x.com/aa", "block"), ("net/bb", "block"), ("net/bb", "block"), (None, "allow")]
    for n in (url_filter.PREFIX_BYTES, 0):  # without a prefix, every rule meets every expression
        monkeypatch.setattr(url_filter, "PREFIX_BYTES", n)
        out = url_filter.judge_urls(pages, rules, broadcast_rules=bound).orderBy("page_id").collect()
        assert [(r.rule, r.verdict) for r in out] == want


def test_spotsigs_least_identifier(spark):
    low = -(1 << 63)
    docs = spark.createDataFrame([(low, "the lowest of all texts"), (None, "a text without a name"), (4, "the last one")], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_chars) for r in spotsigs.neighbour_report(docs).collect()} == {(low, 23), (None, 21), (4, 12)}


def test_ids_wider_than_two_bytes(spark, tmp_path):
    import io
    import struct

    import public_tokenizers

    from sparkloom.llm import sstable

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    rows = sstable.read_shards(spark, sstable.write_shards(docs, path, str(tmp_path / "w"), end_id=70_000), keep_ids=True).collect()
    assert all(struct.unpack("<I", bytes(r.ids)[-4:])[0] == 70_000 for r in rows) and len(rows) == 2
    with pytest.raises(ValueError):
        sstable.ShardWriter(io.BytesIO(), 2).add(1, struct.pack("<I", 70_000))


def test_words_that_share_a_hash(monkeypatch):
    import numpy as np
    import public_tokenizers

    from sparkloom.llm import shingles, sstable

    path = public_tokenizers.path("word_bpe_49k.json")
    e = sstable.WordEncoder(path)
    monkeypatch.setattr(shingles, "hash_pieces", lambda joined, starts, ends: np.full(len(starts), 7, np.uint64))
    want = sstable.WordEncoder(path)._each([b"morning", b"evening"])
    got = [np.frombuffer(e.encode([w])[0], "<u4").tolist() for w in (b"morning", b"evening", b"morning")]
    assert got == [want[0], want[1], want[0]]


def test_long_urls(spark):
    """A host of a million labels and a path of ten million characters are judged in seconds, as the definition says."""
    import time

    urls = ["https://" + "a." * 1_000_000 + "NET/de/8", "https://x.com/en/" + "p" * 10_000_000, "https://" + "b" * 1_000_000 + ".example.com/en/7", "x" * 1_000_000, "https://" + "." * 500_000 + "com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    began = time.time()
    rows = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.rules_table(spark)).collect()}
    assert time.time() - began < 60
    assert [(rows[k].rule, rows[k].verdict) for k in range(5)] == [("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), (None, "allow"), ("com/en/", "block")]
    assert len(rows[0].host) == 2_000_003 and len(rows[1].path) == 10_000_004 and rows[3].host == rows[3].path == ""
