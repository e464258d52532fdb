"""The Jaccard join's regions, pivots and its ways beyond what is broadcast, against brute force or planted links."""

import random
from collections import Counter

import pytest
from test_operators import brute_components, shingles

from sparkloom.llm import jaccard_join


def crowd(rng, n, words=80, edits=6):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def table(spark, texts, seed=1):
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)


@pytest.mark.parametrize("limits", [{"BROADCAST_ROWS": 3}, {"MAX_FREQUENT": 5}, {"MAX_PIVOTS": 6}, {"PIVOT_BYTES": 700}, {"HITS": 50, "FLUSH": 200}, {"MAX_PIVOTS": 0}, {"CLOSE": 1}])
def test_bounds_change_nothing(spark, monkeypatch, limits):
    rng = random.Random(8)
    rows, docs = table(spark, crowd(rng, 60) + crowd(rng, 40, 30, 4) + [" ".join(f"v{rng.randrange(60)}" for _ in range(12)) for _ in range(60)])
    for k, v in limits.items():
        monkeypatch.setattr(jaccard_join, k, v)
    assert Counter(map(tuple, jaccard_join.components_of(docs).collect())) == brute_components(rows)


def test_pivots_at_small_size(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    src = docs.selectExpr("doc_id AS id", "cast(coalesce(text, '') AS binary) AS t")
    points = jaccard_join._scan(src).where("kind = 2").selectExpr("key AS id", "n", "sid", "name", "h", "set AS crowd").cache()
    pivots, root, members = jaccard_join._regions_of_pivots(src, points)
    assert len(pivots) > 10 and root.count() >= len(pivots) and members.count() > 0


def test_large_crowd(spark):
    """10,000 near copies of which every one is linked with the unedited text, and one text that is near but not linked."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base)]
    for _ in range(10_000):
        w = list(base)
        for at in rng.sample(range(200), 3):
            w[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    texts.append(" ".join(base[:150] + [f"y{k}" for k in range(50)]))
    _, docs = table(spark, texts)
    got = Counter(r.component_id for r in jaccard_join.components_of(docs).collect())
    assert got == Counter({0: 10_001, 10_001: 1})


def test_region_by_brute_force():
    import numpy as np

    rng = random.Random(5)
    texts = [t for n in (200, 50, 30) for t in crowd(rng, n, 40, 5)] + [" ".join(f"u{rng.randrange(30)}" for _ in range(9)) for _ in range(100)]
    from sparkloom.llm.shingles import Sets

    sets = Sets([t.encode() for t in texts])
    for sides in ([3] * len(texts), [rng.choice((1, 2, 3)) for _ in texts]):
        region = jaccard_join._Region([(sets.names[j], sides[j], sets[j].tobytes()) for j in range(len(texts))])
        root = {n: n for n in sets.names}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in region.links:
            root[find(u)] = find(v)
        words = [shingles(t) for t in texts]
        for i in range(len(texts)):
            for j in range(len(texts)):
                if sides[i] & 1 and sides[j] & 2 and 100 * len(words[i] & words[j]) >= 75 * len(words[i] | words[j]):
                    assert find(sets.names[i]) == find(sets.names[j])
        place = {n: k for k, n in enumerate(sets.names)}
        for u, v in region.links:
            a, b = words[place[u]], words[place[v]]
            assert 100 * len(a & b) >= 75 * len(a | b)
        assert len({bytes(n) for n in sets.names}) == len({w for w in words}) and np.all(sets.sizes > 0)
