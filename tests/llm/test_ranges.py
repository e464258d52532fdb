"""Conversations that span ranges, and more sources than are broadcast."""

from collections import Counter

import pytest

from sparkloom.llm import chat, mixing


def plain(turns):
    """(conversation, perspective) -> rendering, by loops."""
    out = {}
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "unknown", t[3] or "")
    for c in {t[0] for t in turns}:
        rows = sorted((t for t in turns if t[0] == c), key=key)
        for p in {t[2] or "unknown" for t in rows} - {"system"}:
            text = ""
            for _, _, r, x in rows:
                r = r or "unknown"
                text += ("<|assistant|>\n" if r == p else "<|system|>\n" if r == "system" else f"<|user|>\n{r}: ") + (x or "") + "<|end|>\n"
            out[c, p] = text
    return out


@pytest.mark.parametrize("bound", [chat.BROADCAST_ROWS, 0])
def test_long_conversations(spark, monkeypatch, bound):
    monkeypatch.setattr(chat, "BROADCAST_ROWS", bound)
    turns = [(c, t, ("ann", "bob", "system", None, "cy")[(t * 7 + (c or 0)) % 5], "x" * (t % 13)) for c, n in ((1, 400), (2, 3), (None, 150), (4, 1)) for t in range(n)] + [(5, None, "ann", "long " * 20_000), (5, 0, "bob", None), (5, 0, "bob", None)]
    df = spark.createDataFrame([(*t, "p", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, perspective string, start int").repartition(5)
    rows = chat.rotate(df).collect()
    text: dict = {}
    for r in sorted(rows, key=lambda r: r.start):
        k = r.conv_id, r.perspective
        assert len(text.setdefault(k, "")) == r.start
        text[k] += r.segment
        if r.mask_start is not None:
            assert r.role == r.perspective and r.segment[r.mask_start - r.start : r.mask_end - r.start].endswith("<|end|>\n")
    assert text == plain(turns)


def test_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 17), f"s{i * i % 41}" if i % 9 else None, "x") for i in range(600)], "doc_id bigint, text string, source string, target string").repartition(4)
    want = Counter(map(tuple, mixing.weighted_mix(docs).collect()))
    monkeypatch.setattr(mixing, "MANY_SOURCES", 3)
    assert Counter(map(tuple, mixing.weighted_mix(docs).collect())) == want
