"""The pipeline's stages against plain versions, each on its own input."""

from collections import Counter

import corpus_pipeline
from llm.test_operators import brute_components

from sparkloom.llm import quality_knn


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = docs
    for (name, stage), n in zip(corpus_pipeline.STAGES, range(5)):
        before = [tuple(r) for r in seen.collect()]
        out = stage(spark, seen, sf)
        after = [tuple(r) for r in out.collect()]
        if n < 4:
            assert out.columns == docs.columns, name
            assert set(after) <= set(before)
        if n == 0:
            kept = {r[0] for r in after}
            clean = [r[0] for r in before if labels.get(r[0]) == 1]
            assert len([i for i in clean if i in kept]) >= 0.95 * len(clean)
            bad = [r[0] for r in before if labels.get(r[0]) == 0]
            assert len([i for i in bad if i in kept]) <= 0.5 * len(bad)
        elif n == 1:
            groups = {}
            for r in before:
                groups.setdefault(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
            assert Counter(r[0] for r in after) == Counter(min(g) for g in groups.values())
        elif n == 2:
            assert {r[0] for r in after} == {c for _, _, c in brute_components([(r[0], r[1]) for r in before])}
        elif n == 3:
            assert max(Counter(after).values()) <= 2 and 1.2 < len(after) / len(before) < 1.8
        else:
            assert len(after) == len(before)
        seen = spark.createDataFrame(after, out.schema)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
    assert quality_knn.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), __import__("pyspark").sql.functions.lit(True)) is None
