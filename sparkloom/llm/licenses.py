"""Licence scans: matching statistics against a generalised suffix automaton of licence words, chained into spans.

The automaton holds every run of consecutive words of the templates and phrases. Each text is
streamed through it word by word: after each word it stands at the longest run that ends there. A run
that cannot be made longer and has ``MIN_RUN`` words is an anchor at each of its places in the
templates; anchors of one template that follow each other, at most ``MAX_GAP`` words apart, are
chained, and a chain that covers ``least`` of a template's words is a span with the template's label.
Places of phrases are read off the states' suffix links, so they are exact, overlaps included.

Rows are scanned where they lie: nothing is shuffled. The automaton is built in each Python worker from
the templates, which are refused beyond ``MAX_WORDS`` words; a text's open chains reach back only
``MAX_GAP`` words, so that memory beside the text itself does not grow with repeated passages.

Defined cases: a null text counts as empty; an empty one has no words, no labels and score 0; null
identifiers and repeated rows are rows of their own; an empty table gives an empty result; extra
columns are ignored; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from sparkloom.llm.common import slices

#: Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices of well-known licences, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)
MIN_RUN = 3
MAX_GAP = 12
MAX_WORDS = 200_000
#: Bytes that belong to a word stay, letters A to Z lower-cased; all others become spaces.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


class Automaton:
    """A generalised suffix automaton over the words of several texts."""

    def __init__(self, templates: tuple, phrases: tuple):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, ends = [-1], [0], [[]]
        texts = [words_of(t.encode()) for _, t in templates]
        phrase_words = [words_of(p.encode()) for p, _ in phrases]
        if sum(map(len, texts)) + sum(map(len, phrase_words)) > MAX_WORDS:
            raise ValueError(f"templates have more than {MAX_WORDS} words")
        self.sizes = [len(t) for t in texts]
        self.labels = [label for label, _ in templates]
        for k, words in enumerate([*texts, *phrase_words]):
            at = 0
            for place, w in enumerate(words):
                at = self._add(at, w, ends)
                if k < len(texts):
                    ends[at].append((k, place))
        self.vocabulary = {w for step in self.next for w in step}
        # A state's runs end wherever those of the states that link to it do; longer states come first.
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            if self.len[v] >= MIN_RUN and self.link[v] > 0:
                ends[self.link[v]] += ends[v]
        self.ends = [sorted(set(e)) for e in ends]
        own: dict[int, list[int]] = {}
        for k, words in enumerate(phrase_words):
            at = 0
            for w in words:
                at = self.next[at][w]
            own.setdefault(at, []).append(k)
        self.phrase_sizes = [len(p) for p in phrase_words]
        self.phrases = [()] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=lambda v: self.len[v]):
            self.phrases[v] = (*own.get(v, ()), *self.phrases[self.link[v]])

    def _state(self, size: int, step: dict, link: int, ends: list) -> int:
        self.next.append(step)
        self.link.append(link)
        self.len.append(size)
        ends.append([])
        return len(self.len) - 1

    def _split(self, at: int, w: bytes, to: int, ends: list) -> int:
        """The state of the run ``at`` + ``w`` alone, cut off from the longer runs of ``to``."""
        if self.len[to] == self.len[at] + 1:
            return to
        short = self._state(self.len[at] + 1, dict(self.next[to]), self.link[to], ends)
        self.link[to] = short
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = short
            at = self.link[at]
        return short

    def _add(self, at: int, w: bytes, ends: list) -> int:
        """The state behind ``at`` and ``w``, made if there is none."""
        if w in self.next[at]:
            return self._split(at, w, self.next[at][w], ends)
        new = self._state(self.len[at] + 1, {}, 0, ends)
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, w, self.next[at][w], ends)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(places, anchors) of a text: (first word, phrase) of every phrase; (last word, length, state) of every run of ``MIN_RUN`` words that ends."""
        nxt, link, size, phrases, known = self.next, self.link, self.len, self.phrases, self.vocabulary
        places, anchors, v, n = [], [], 0, 0
        for i, w in enumerate(words):
            if w not in known:
                if n >= MIN_RUN:
                    anchors.append((i - 1, n, v))
                v = n = 0
                continue
            if w not in nxt[v]:
                if n >= MIN_RUN:
                    anchors.append((i - 1, n, v))
                while v and w not in nxt[v]:
                    v = link[v]
                n = size[v]
            v = nxt[v].get(w, 0)
            n = n + 1 if v else 0
            for k in phrases[v]:
                if n >= self.phrase_sizes[k]:
                    places.append((i - self.phrase_sizes[k] + 1, k))
        if n >= MIN_RUN:
            anchors.append((len(words) - 1, n, v))
        return places, anchors

    def chains(self, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, words covered) of the best chain that ends at each anchor, for every template it lies in."""
        out, open_ = [], {}
        for last, n, v in anchors:
            for t, end in self.ends[v]:
                near = [c for c in open_.get(t, ()) if c[1] >= last - n - MAX_GAP]
                best = (last - n + 1, last, end, n)
                for first, before, t_end, covered in near:
                    own = min(n, last - before, end - t_end)
                    if own > 0 and covered + own > best[3]:
                        best = (first, last, end, covered + own)
                open_[t] = [*near, best]
                out.append((t, best[0], last, best[3]))
        return out


@lru_cache(maxsize=4)
def automaton(templates: tuple, phrases: tuple) -> Automaton:
    return Automaton(templates, phrases)


def spans(a: Automaton, anchors: list[tuple[int, int, int]], least: float) -> tuple[list[tuple[str, int, int, float]], float]:
    """(spans, best share): (label, first word, last word, share of the template) of chains that cover ``least``, best first where they overlap."""
    found = [(covered / a.sizes[t], a.labels[t], first, last) for t, first, last, covered in a.chains(anchors)]
    best: dict[tuple[str, int], tuple] = {}
    for share, label, first, last in found:
        if share >= least and (share, last) > best.get((label, first), (0.0, 0))[:2]:
            best[label, first] = (share, last)
    return sorted((label, first, last, share) for (label, first), (share, last) in best.items()), max((f[0] for f in found), default=0.0)


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,share:double>>"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words count from 0. The score is the largest share of a template that a chain covers, 1 where a phrase stands.
    """
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([docs.select(id_col).schema[0], *StructType.fromDDL(SCHEMA).fields])
    arrow, templates, phrases = to_arrow_schema(schema), tuple(map(tuple, templates)), tuple(map(tuple, phrases))

    def row(a: Automaton, text: bytes | None) -> tuple:
        words = words_of(text or b"")
        places, anchors = a.scan(words)
        found, score = spans(a, anchors, least) if anchors else ([], 0.0)
        base = {phrases[k][1] for _, k in places}
        labels = base | {s[0] for s in found}
        starts = [i for i, _ in places]
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 if places else min(1.0, score), [dict(zip(("label", "first", "last", "share"), s)) for s in found],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(templates, phrases)
        for batch in (part for whole in batches for part in slices(whole, 8 << 20)):
            rows = [row(a, t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
