"""Alignment, spelling variants and licence scans against plain versions; nulls, empty and long texts, repeats, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from sparkloom.llm import alignment, licenses, spelling
from sparkloom.llm.queries import QUERIES

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [
    (1, "Weather weather weather wether wehather, wxather! École ÉCOLE élevage ÿÿÿÿÿÿÿ"),
    (2, "weather  weather\n weather\tweatherr weathe'r weatheR WEATHER été"),
    (2, "weather  weather\n weather\tweatherr weathe'r weatheR WEATHER été"),
    (None, "weather weatherr aaaaaaa aaaaaaaa aaaaaaa aaaaaaaa abababa bababab"),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "▁ marked text ▁x"),
    (7, "<|endoftext|> <s> </s> <0x41> don't 's 日本語 \x00 a\u0085b  c\x1c d "),
    (8, "long " * 5000 + "x" * 3000),
    (9, "This work is licensed under the GNU General Public License, version 3. CC by. cc-by, all rights reserved all rights reserved"),
    (10, "LICENSED under the apache license VERSION 2.0"),
    (11, "general public general public license rights reserved all rights"),
    (12, "Permission is hereby granted, free of charge, to ANY person who is obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    return df.withColumns({c: F.lit("x") for c in ("word", "n", "run", "i", "row", "links", "pair", "n_a", "spans", "score", "w", "key", "way")})


def plain_alignment(texts):
    """Rows of the contract by encoding whole texts and comparing all tokens."""
    al = alignment.aligner(A_FILE, B_FILE)
    found, counts = [], Counter()
    for t in texts:
        row = None
        if t:
            ids = al.a.encode(" " + t, add_special_tokens=False).ids, al.b.encode(t)
            parts = [[side[i] for i in x] for side, x in zip(al.bytes, ids)]
            if b"".join(parts[0]) == b"".join(parts[1]) == (" " + t).encode():
                ends = []
                for p in parts:
                    n, out = 0, []
                    for x in p:
                        n += len(x)
                        out.append(n)
                    ends.append(out)
                links, i, j = [], 0, 0
                for e in sorted(set(ends[0]) | set(ends[1])):
                    links.append((ids[0][i], ids[1][j]))
                    i += ends[0][i] == e
                    j += ends[1][j] == e
                groups, a, b = [], 0, 0
                for c in sorted(set(ends[0]) & set(ends[1])):
                    x, y = ends[0].index(c, a) + 1, ends[1].index(c, b) + 1
                    groups.append(",".join(map(str, ids[0][a:x])) + "|" + ",".join(map(str, ids[1][b:y])))
                    a, b = x, y
                row = (len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
                counts.update(links)
        found.append(row)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in found]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment(docs, spark, broadcast_pairs, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_SHARE", 4)
    out = alignment.align(docs, A_FILE, B_FILE, broadcast_pairs=broadcast_pairs)
    want = Counter((i, *r) for (i, _), r in zip(DOCS, plain_alignment([t for _, t in DOCS])))
    assert Counter(map(tuple, out.collect())) == want
    assert sum(r[1] == 0 for r in want) == 3  # null, empty, marked
    assert alignment.align(docs.limit(0), A_FILE, B_FILE).collect() == []


def test_alignment_stretches_equal_whole_texts():
    random.seed(3)
    bits = ["the", "The", " ", "  ", "\n", "\t", " \n", "é", "ß", "日本語", "▁", "don't", "'s", " 'll", "123", "\x1c", "\x85", " ", "　", "<|endoftext|>", "<s>", "!!!", "😀", "\x00", "a", "İ", "ﬁ", "é", "ⅷ", "ǆ", "​", "_", "Ä"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(4000)]
    al = alignment.aligner(A_FILE, B_FILE)
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in al.rows(texts)] == [(r[0], r[1], r[2], r[3], r[6]) for r in plain_alignment(texts)]


def test_union_find_groups():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        links = rng.integers(0, n, (int(rng.integers(1, 60)), 2))
        name = list(range(n))
        for x, y in [*links.tolist()] * n:
            name[x] = name[y] = min(name[x], name[y])
        assert alignment.components(links[:, 0], links[:, 1], n).tolist() == [name[x] for x in links[:, 0]]


def plain_spelling(docs, shortest=7, least=2, ratio=10, every=31):
    c = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if every and h % every == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            c[r] += 1
    words = {w: n for w, n in c.items() if len(w) >= shortest and n >= least}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        b = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = b if b and words[b] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling(docs, spark, sf):
    assert set(map(tuple, spelling.variants(docs).collect())) == plain_spelling(DOCS)
    kw = {"shortest": 2, "least": 1, "ratio": 2, "every": 3}
    assert set(map(tuple, spelling.variants(docs, **kw).collect())) == plain_spelling(DOCS, **kw)
    assert spelling.variants(docs.limit(0)).collect() == []
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert set(map(tuple, QUERIES["op12_spelling"](spark, sf).collect())) == plain_spelling(rows)


def test_spelling_chains_and_dense_words(spark):
    random.seed(5)
    dense = ["".join(random.choice("ab") for _ in range(random.randint(1, 7))) for _ in range(3000)]
    chain = ["abcdefgh"] * 5000 + ["abcdefgx"] * 500 + ["abcdefyx"] * 50 + ["abcdzyx"] * 5
    texts = [(k, " ".join(part)) for k, part in enumerate((dense, chain))]
    for kw in ({"shortest": 1, "least": 1, "ratio": 2, "every": 0}, {"shortest": 7}):
        got = set(map(tuple, spelling.variants(spark.createDataFrame(texts, "doc_id int, text string"), **kw).collect()))
        assert got == plain_spelling(texts, **kw)


def test_suffix_automaton():
    """Places of phrases, matching statistics and their places in the templates, against all runs of words."""
    random.seed(1)
    for _ in range(200):
        voc = [f"w{i}" for i in range(random.choice([2, 3, 6]))]
        templates = tuple((f"t{k}", " ".join(random.choices(voc, k=random.randint(1, 12)))) for k in range(random.randint(1, 5)))
        phrases = tuple((" ".join(random.choices(voc, k=random.randint(1, 4))), f"p{k}") for k in range(3))
        a = licenses.Automaton(templates, phrases)
        words = [w.encode() for w in random.choices([*voc, "zz"], k=60)]
        places, anchors = a.scan(words)
        long_, short = [[w.encode() for w in x.split()] for _, x in templates], [[w.encode() for w in x.split()] for x, _ in phrases]
        runs = {tuple(x[i:j]) for x in long_ + short for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        assert sorted(places) == sorted((i, k) for k, p in enumerate(short) for i in range(len(words)) if words[i : i + len(p)] == p)
        most = [max(n for n in range(min(i + 1, 12) + 1) if n == 0 or tuple(words[i - n + 1 : i + 1]) in runs) for i in range(len(words))]
        ending = [(i, n) for i, n in enumerate(most) if n >= licenses.MIN_RUN and (i + 1 == len(words) or most[i + 1] != n + 1)]
        assert [(i, n) for i, n, _ in anchors] == ending
        for i, n, v in anchors:
            assert a.ends[v] == sorted((k, e) for k, x in enumerate(long_) for e in range(n - 1, len(x)) if x[e - n + 1 : e + 1] == words[i - n + 1 : i + 1])


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(docs, spark, sf):
    rows = licenses.scan(docs).collect()
    assert Counter((r.doc_id, *r[1:6]) for r in rows) == Counter((i, *plain_base(t)) for i, t in DOCS)
    by = {r.doc_id: r for r in rows}
    assert by[9].labels == "cc-by,gpl,gpl-3.0,reserved" and by[9].score == 1.0
    assert (by[10].labels, by[10].score) == ("apache-2.0", 1.0) and by[10].spans[0].asDict() == {"label": "apache-2.0", "first": 0, "last": 7, "share": 1.0}
    assert by[12].labels == "mit" and 0.75 <= by[12].score < 1  # two words put in, two left out: one span over all
    assert (by[12].spans[0].first, by[12].spans[0].last) == (0, 28)
    assert by[4].score == by[3].score == 0.0 and by[4].labels == "" and by[11].labels == "gpl"
    assert licenses.scan(docs.limit(0)).collect() == []
    out = {r.doc_id: r for r in QUERIES["op13_licenses"](spark, sf).collect()}
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        assert tuple(out[i])[1:6] == plain_base(t)
        assert set(filter(None, out[i].base_labels.split(","))) <= set(out[i].labels.split(",")) and 0 <= out[i].score <= 1


def test_alignment_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {i: r for (i, _), r in zip(rows, plain_alignment([t for _, t in rows]))}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_alignment"](spark, sf).collect()} == want
