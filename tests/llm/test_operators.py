"""Operators against plain versions on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import pytest
from oracle import compare

from sparkloom.llm import chat, exact_dedup, jaccard_join, langid, mixing, pieces, quality_knn, spotsigs, sstable, url_filter
from sparkloom.llm.queries import ORACLES, QUERIES

SPACE = r"[\x20\x09-\x0D]+"
LONG = "word " * 4000 + "end"
DOCS = [
    (5, "The cat sat on the mat and the dog ran to a big house by the river side", "en", "a"),
    (1, "The  cat\tsat on the mat and the dog ran to a big house by the river side", "en", "b"),
    (2, "the cat sat on the mat and the dog ran to a big house by the river bank", "en", None),
    (3, None, None, "a"),
    (4, "", "en", "b"),
    (6, "   ", "en", "c"),
    (7, LONG, "en", "c"),
    (8, LONG, "en", "c"),
    (9, "one two", "en", "d"),
    (9, "one two", "en", "d"),
    (None, "one two", "en", "d"),
    (10, "ONE two", None, ""),
    (11, "éàü ﬁ ß İ 12,3 ... <|endoftext|> 's don't", "fr", "é"),
    (12, "x" * 3000, "en", "a"),
    (13, "!!! ??? ...", "en", "a"),
]
COLUMNS = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """The table with extra columns that have the operators' own names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS, COLUMNS)
    return df.withColumns({c: F.lit("x") for c in ("score", "kept", "keep_id", "b", "k", "i", "t", "n", "sid", "size", "target", "__n", "start", "key", "set")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLES[name], sf) > 0


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t, *_ in DOCS:
        groups.setdefault(re.sub(SPACE, " ", t or ""), []).append(i)
    rows = exact_dedup.exact_dedup(docs, buckets_per_partition=3).collect()
    assert len(rows) == len(DOCS)
    first = lambda ids: None if None in ids else min(ids)
    want = Counter((i, first(groups[n]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t, *_ in DOCS for n in [re.sub(SPACE, " ", t or "")])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(hashlib.sha256(n.encode()).hexdigest() for n in groups)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_hot_group_spans_ranges(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    hot = [r for r in out if r.doc_id % 3]
    assert {(r.keep_id, r.group_size) for r in hot} == {(1, 2000)} and [r.doc_id for r in hot if r.kept] == [1]
    assert all(r.kept and r.group_size == 1 for r in out if r.doc_id % 3 == 0)


def test_mixing(docs, empty):
    rows = mixing.weighted_mix(docs).collect()
    assert len(rows) == len(DOCS)
    sizes = Counter()
    for i, t, _, s in DOCS:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(r.taken in (0, r.size, 2 * r.size) and r.target <= 2 * r.source_size for r in rows)
    assert sum(r.taken for r in rows) <= sum(targets.values())
    assert sorted(mixing.weighted_mix(docs).collect(), key=str) == sorted(rows, key=str)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.times for r in rows)
    assert mixing.weighted_mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/7?x=1", "https://a.b.example.com/en/8", "http://xexample.com/en/", "ftp://example.net/de/81#z", "http://net/de/", "http://org/es/x", "http://a.org/es", "x://com/en/\n", "http:///en/", "a://b://com/en/"]


@pytest.mark.parametrize("bound", [1000, 0])
def test_url_filter(spark, bound):
    def plain(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        return host, path, rule, verdict

    pages = spark.createDataFrame([(i // 2, u) for i, u in enumerate(URLS)] + [(None, URLS[3])] * 2, "page_id bigint, url string")
    rows = url_filter.judge_urls(pages, url_filter.rules_table(spark), broadcast_rules=bound).collect()
    assert Counter(tuple(r)[1:] for r in rows) == Counter(plain(u) for u in [*URLS, URLS[3], URLS[3]])
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_table(spark)).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(pages, url_filter.rules_table(spark, ())).collect()} == {"allow"}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(s), low.get(find(k), i)) for k, (i, s) in enumerate(sets))


def test_jaccard_join(docs, empty):
    rows = jaccard_join.components_of(docs).collect()
    assert Counter(map(tuple, rows)) == brute_components([(r[0], r[1]) for r in DOCS])
    assert jaccard_join.components_of(empty).collect() == []
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 6, 7, 9, 11, 12, 13] or sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute_components([(r[0], r[1]) for r in DOCS])})


def test_jaccard_join_crowds(spark, monkeypatch):
    """Near copies of one text, enough to become pivots, chains of links, a passage that all share, and single texts."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    w = list(base)
    for i in range(150, 190):
        w[(i * 7) % 60] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join([word() for _ in range(rng.randrange(1, 30))] + passage)) for i in range(190, 260)]
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = jaccard_join.components_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_spotsigs(spark, docs, empty):
    rows = spotsigs.neighbour_report(docs).collect()
    ordered = sorted(((i, t or "") for i, t, *_ in DOCS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        n = len(t) // 4
        edited = t[: len(t) - n] + ordered[(k + 1) % len(ordered)][1][:n]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert spotsigs.neighbour_report(empty).collect() == []
    one = spotsigs.neighbour_report(spark.createDataFrame([(3, "the quick fox and a lazy dog")], "doc_id bigint, text string")).collect()[0]
    assert one.near_next == 1.0


def test_spotsigs_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pairs, members = spotsigs.near_pairs(docs)
    fps = {r.doc_id: frozenset(r.fingerprint.split()) for r in spotsigs.neighbour_report(docs).collect()}
    name = {}
    for i in sorted(fps):
        name.setdefault(fps[i], i)
    assert {(r["id"], r["class"]) for r in members.collect()} == {(i, name[s]) for i, s in fps.items()}
    sets = [(i, s) for s, i in name.items() if s]
    want = {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if 100 * len(x & y) >= 75 * len(x | y)}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_sstable(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for n, table in enumerate((docs, empty)):
        manifest = sstable.write_shards(table, path, str(tmp_path / f"s{n}"), end_id=1)
        rows = sstable.read_shards(spark, manifest, keep_ids=True).collect()
        want, start = [], 0
        data = sorted(((i, t or "") for i, t, *_ in DOCS), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())) if table is docs else []
        for i, t in data:
            ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
            raw = struct.pack(f"<{len(ids)}I", *ids)
            want.append((i, start, len(ids), zlib.crc32(raw), raw))
            start += len(ids)
        assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in rows), key=lambda r: r[1]) == want
        for m in manifest:
            shard = sstable.Shard(m["path"])
            assert shard.get(10_000) is None
            for i, _, _, _, raw in want:
                assert raw in shard.get_all(i) or not ((m["lo"] is None or (i is not None and m["lo"] <= i)) and (i is None or (m["hi"] is not None and i <= m["hi"])))


def test_words_as_whole_texts(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), sstable.WordEncoder(path)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["a.b,c!? d'll 'S (x)y… «z». <|endoftext|>. <|ENDOFTEXT|> é., e\u0301. \u3000x ٣. Ⅷ. _a_-", "", " "]
    assert enc.encode([t.encode() for t in texts]) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_pieces(spark, sf, docs, empty):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [t or "" for _, t, *_ in DOCS] + [" a", "a ", "  a  b ", "▁x ▁", "a\nb\r\n c", "\U0001f600 ﷽", " "]
    ids = sp.encode(texts, add_bos=True, add_eos=True)
    got = pieces.Coder(model).encode_decode(texts)
    for t, e, d, (i, b) in zip(texts, ids, sp.decode(ids), got):
        assert i == struct.pack(f"<{len(e)}I", *e) and b == d, t
    assert pieces.encode_decode(docs, model).count() == len(DOCS) and pieces.encode_decode(empty, model).collect() == []


def test_quality(spark, sf, docs, empty):
    d, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    model = quality_knn.fit(d, labels, quality_knn.remainder(F.col("doc_id"), 3) != 1)
    held = quality_knn.quality_scores(d, model).join(labels, "doc_id").where(quality_knn.remainder(F.col("doc_id"), 3) == 1).collect()
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    rows = quality_knn.quality_scores(docs, model).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality_knn.accepted(docs, model).columns == docs.columns
    assert quality_knn.fit(d, labels.limit(0), F.lit(True)) is None and {r.score for r in quality_knn.quality_scores(docs, None).collect()} == {0.5}
    assert quality_knn.quality_scores(empty, model).collect() == [] and quality_knn.accepted(empty, model).collect() == []


def test_languages(spark, sf, docs, empty):
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit(d, rest != 2)
    held = langid.predict_languages(d, model).join(d.select("doc_id", "lang"), "doc_id").where(rest == 2).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    rows = {r.doc_id: r for r in langid.predict_languages(docs, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 6, 13)) and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.fit(empty, F.lit(True)) is None and langid.predict_languages(empty, model).collect() == []


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hey ann"), (1, 2, "ann", None), (2, 0, None, "alone"), (None, 1, "x", "q"), (None, 1, "x", "q"), (3, 0, "system", "only")]
    rows = chat.rotate(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()
    text = {}
    for r in sorted(rows, key=lambda r: r.start):
        key = r.conv_id, r.perspective
        assert len(text.setdefault(key, "")) == r.start
        text[key] += r.segment
    assert set(text) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "x")}
    assert text[1, "bob"] == "<|system|>\nbe kind<|end|>\n<|user|>\nann: hi<|end|>\n<|user|>\nann: <|end|>\n<|assistant|>\nhey ann<|end|>\n"
    assert [text[1, "bob"][r.mask_start : r.mask_end] for r in rows if r.perspective == "bob" and r.mask_start is not None] == ["hey ann<|end|>\n"]
    assert chat.rotate(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
