"""Cross-tokenizer alignment: groups of overlapping tokens by union-find, link counts by Spark aggregation.

Two tokenizers cut the same bytes (a space and the text). Tokens of both are the nodes of a
bipartite graph, overlapping tokens are linked, and the connected components, found by union-find, are
the smallest groups that begin and end in both. Both tokenizers begin a new token at a space
behind a character that is not white space, so each distinct stretch of text between such places
is encoded and grouped once in a Python worker (until its table has ``MAX_STRETCHES`` of them) and
a document's groups are those of its stretches in order.

Each document's rows keep its distinct id pairs with their links; pairs are counted over the corpus with
map-side sums, and the counts are joined back. The counts are broadcast up to ``BROADCAST_PAIRS`` pairs.
Beyond that they meet the documents by shuffle, all but pairs that more than one in ``HOT_SHARE`` of the
rows have: fewer than ``HOT_SHARE`` pairs fall under that times a row's mean number of pairs, and only those are broadcast.

Defined cases: a null or empty text, or one whose tokens of either kind do not give back its bytes,
has no tokens: zeros and an empty ``groups_sha256``; strings of special tokens are plain text; texts may be of any
length; null identifiers and repeated rows are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, slices

#: Python's white space holds all that either tokenizer takes for it, so text is cut at sure places only.
BREAK = re.compile(r"(?<=\S) ")
SPACES = re.compile(r"\s ")
#: Fixed value: the pattern that a byte-level tokenizer cuts text by before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Latin stretches that do not end in white space, so that others can follow them in one call.
PLAIN = re.compile(r"[\x00-\u024f]*[!-\u007e]")
MAX_STRETCHES = 500_000
SLICE_BYTES = 4 << 20
BROADCAST_PAIRS = 2_000_000
HOT_SHARE = 1000
MARK = "▁"


def stretches_of(text: str) -> list[str]:
    """``text`` cut at its breaks; a stretch stands behind the space of its break (the first one behind the added space)."""
    return text.split(" ") if text[0] != " " and not SPACES.search(text) else BREAK.split(text)


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


def components(left, right, n: int):
    """The component of each link (left, right) over nodes 0 to n - 1, named by its least node: union-find on arrays.

    A round hooks each link's roots, the greater one below the lesser, and then halves all paths to the roots.
    """
    import numpy as np

    parent, every = np.arange(n), left
    while True:
        x, y = parent[left], parent[right]
        apart = x != y
        if not apart.any():
            return parent[every]
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not (parent == (up := parent[parent])).all():
            parent = up


class Aligner:
    """Token ids, groups and links of stretches of text; a stretch's are worked out once and kept."""

    def __init__(self, a_file: str, b_file: str):
        import numpy as np
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in p): i for p, i in self.a.get_vocab(with_added_tokens=False).items()}
        a_bytes = [b""] * (max([*ranks.values(), self.a.get_vocab_size()]) + 1)
        for p, i in ranks.items():
            a_bytes[i] = p
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes = a_bytes, [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = tuple(np.array([len(x) for x in side]) for side in self.bytes)
        # A token's number as it stands in a group: inside its side, at the end of A's, at the end of B's.
        self.words = [f"{i}{end}" for end in (",", "|", ";") for i in range(max(map(len, self.bytes)))]
        self.word_sizes = np.array([len(w) for w in self.words])
        self.lone = [self.b.piece_to_id(MARK)]
        self._check(a_file, pieces)
        # The same vocabulary and pattern in a faster library, for the scripts that both know alike.
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _check(self, a_file: str, pieces: list[str]) -> None:
        """Refuses tokenizers whose tokens could reach over a break, as the stretches would then be cut wrongly."""
        with open(a_file, encoding="utf-8") as f:
            j = json.load(f)
        before, model = j.get("pre_tokenizer") or {}, j["model"]
        if j.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("the first tokenizer must be byte-level, without normalizer or added space")
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if made != sorted(made) or model.get("ignore_merges"):
            raise ValueError("the first tokenizer's merges must be in the order of their ids")
        probe = "ａ  b "
        same = b"".join(self.bytes[1][i] for i in self.b.encode(probe)) == f" {probe}".encode()
        if any(MARK in p.lstrip(MARK) for p in pieces) or not same:
            raise ValueError("the second tokenizer must not join words, normalise text or drop spaces")

    def _forget(self) -> None:
        """Empties the table of stretches; entry 0 is that of stretches without tokens.

        Entry k has ``numbers[k]`` (tokens of A, of B, groups), and its groups as text and its links' pairs lie
        behind each other in two arrays, up to ``texts_end[k]`` and ``pairs_end[k]``.
        """
        import numpy as np

        self.known: dict[str, int] = {}
        self.numbers = np.zeros((1, 3), np.int64)
        self.texts, self.pairs = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.texts_end = self.pairs_end = np.zeros(1, np.int64)

    def _tokens(self, new: list[str]):
        """(stretches in another order, A's ids, number of each one's, B's ids, number of each one's) without those that the ids do not give back."""
        import numpy as np

        plain = [s for s in new if PLAIN.fullmatch(s)]
        other = [s for s in new if not PLAIN.fullmatch(s)]
        a_plain = np.array(self.fast.encode_ordinary("".join(" " + s for s in plain)), np.int64)
        a_upto = np.searchsorted(np.cumsum(self.sizes[0][a_plain]), np.cumsum([1 + len(s.encode()) for s in plain]), side="left") + 1
        a_other = [e.ids for e in self.a.encode_batch_fast([" " + s for s in other], add_special_tokens=False)]
        stretches = plain + other
        b_ids = [ids if s else self.lone for s, ids in zip(stretches, self.b.encode(stretches, num_threads=1))]
        a_ids = np.concatenate([a_plain, np.fromiter(chain.from_iterable(a_other), np.int64)])
        a_n = np.concatenate([np.diff(a_upto, prepend=0), np.fromiter(map(len, a_other), np.int64)]).astype(np.int64)
        flat, b_n = np.fromiter(chain.from_iterable(b_ids), np.int64), np.fromiter(map(len, b_ids), np.int64)
        whole = "".join([" " + s for s in stretches]).encode()
        gives = [b"".join(map(side.__getitem__, ids.tolist())) for side, ids in zip(self.bytes, (a_ids, flat))]
        ends = np.cumsum([1 + len(s.encode()) for s in stretches])
        here = [np.cumsum(size[ids])[np.cumsum(n) - 1] if len(n) and n.min() else None for size, ids, n in zip(self.sizes, (a_ids, flat), (a_n, b_n))]
        if all(g == whole for g in gives) and all(h is not None and (h == ends).all() for h in here):
            return stretches, a_ids, a_n, flat, b_n
        kept, at_a, at_b = [], np.r_[0, np.cumsum(a_n)], np.r_[0, np.cumsum(b_n)]
        for k, s in enumerate(stretches):
            sides = [b"".join(map(side.__getitem__, ids[at[k] : at[k + 1]].tolist())) for side, ids, at in zip(self.bytes, (a_ids, flat), (at_a, at_b))]
            kept.append(sides[0] == sides[1] == b" " + s.encode())
        kept = np.array(kept, bool)
        return [s for s, good in zip(stretches, kept) if good], a_ids[np.repeat(kept, a_n)], a_n[kept], flat[np.repeat(kept, b_n)], b_n[kept]

    def learn(self, stretches: set[str]) -> None:
        """Adds the entries of new ``stretches``."""
        import numpy as np

        new = [s for s in stretches if s not in self.known]
        if not new:
            return
        good, a_ids, a_n, b_ids, b_n = self._tokens(new)
        self.known |= dict.fromkeys(new, 0)
        self.known |= zip(good, range(len(self.numbers), len(self.numbers) + len(good)))
        if not good:
            return
        ids, counts = (a_ids, b_ids), (a_n, b_n)
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        # Places where a token of either kind ends: between two of them one token of A overlaps one of B.
        places = np.union1d(*ends)
        at = [np.searchsorted(e, places) for e in ends]
        of = components(at[0], len(ids[0]) + at[1], len(ids[0]) + len(ids[1]))
        first = np.r_[True, of[1:] != of[:-1]]
        group = np.cumsum(first) - 1
        # Tokens in the order of groups, A's before B's, each with the sign that follows it.
        groups = []
        for side in (0, 1):
            g = np.empty(len(ids[side]), np.int64)
            g[at[side]] = group
            groups.append((2 * g + side, ids[side]))
        key, token = (np.concatenate(c) for c in zip(*groups))
        order = np.argsort(key, kind="stable")
        key, token = key[order], token[order]
        last = np.r_[key[1:] != key[:-1], True]
        text = np.where(last, 1 + key % 2, 0) * (len(self.words) // 3) + token
        stretch_end = [np.cumsum(c) for c in counts]
        links_end = np.searchsorted(places, ends[0][stretch_end[0] - 1], side="right")
        groups_end = group[links_end - 1] + 1
        words = "".join(map(self.words.__getitem__, text.tolist())).encode()
        words_end = np.cumsum(self.word_sizes[text])[stretch_end[0] + stretch_end[1] - 1]
        self.texts_end = np.concatenate([self.texts_end, len(self.texts) + words_end])
        self.pairs_end = np.concatenate([self.pairs_end, len(self.pairs) + links_end])
        self.texts = np.concatenate([self.texts, np.frombuffer(words, np.uint8)])
        self.pairs = np.concatenate([self.pairs, ids[0][at[0]] << 32 | ids[1][at[1]]])
        self.numbers = np.concatenate([self.numbers, np.stack([*counts, np.diff(groups_end, prepend=0)], axis=1)])

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs, links of each) of each text."""
        import numpy as np

        if len(self.known) > MAX_STRETCHES:
            self._forget()
        parts = [stretches_of(t) if t else [] for t in texts]
        self.learn(set().union(*parts))
        for stretches in parts:
            at = np.array(list(map(self.known.__getitem__, stretches)), np.int64)
            if not len(at) or not at.all():
                yield 0, 0, 0, 0, "", at[:0], at[:0]
                continue
            pairs = _pieces(self.pairs, self.pairs_end, at)
            text = _pieces(self.texts, self.texts_end, at)[:-1]
            yield *self.numbers[at].sum(axis=0).tolist(), len(pairs), hashlib.sha256(text.tobytes()).hexdigest(), *np.unique(pairs, return_counts=True)


def _pieces(flat, ends, at):
    """The pieces ``at`` of ``flat``, one behind the other; piece k ends at ``ends[k]`` where piece k + 1 begins."""
    import numpy as np

    begin = ends[at - 1]
    size = ends[at] - begin
    upto = np.cumsum(size)
    return flat[np.arange(upto[-1]) + np.repeat(begin - upto + size, size)]


@lru_cache(maxsize=1)
def aligner(a_file: str, b_file: str) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
    return Aligner(a_file, b_file)


def encoded(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_a, n_b, n_groups, n_links, groups_sha256, links (array of (pair, n)); a pair is A's id << 32 | B's id."""
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    schema = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair:bigint,n:bigint>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        both = aligner(a_file, b_file)
        for batch in (part for whole in batches for part in slices(whole, SLICE_BYTES)):
            rows = list(both.rows(batch.column(1).to_pylist()))
            offsets = pa.array(np.cumsum([0, *[len(r[5]) for r in rows]]), pa.int32())
            flat = [pa.array(np.concatenate([np.asarray(r[k], np.int64) for r in rows]), pa.int64()) for k in (5, 6)]
            links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["pair", "n"]))
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([r[4] for r in rows], pa.string()), links], names=names)

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, rows, count, best) of ``links`` (pair, n): rows that have the pair, its links, and whether its B id has none with more."""
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row for each row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = cut(encoded(docs, a_file, b_file, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    links = rows.select("row", F.inline("links"))
    counts = cut(pair_counts(links))
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        met = links.join(F.broadcast(counts), "pair")
    else:
        hot = counts.where(F.col("rows") > rows.count() / HOT_SHARE).select("pair", "count", "best")
        cold = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(counts.hint("merge"), "pair")
        met = links.join(F.broadcast(hot), "pair").select("row", "n", "count", "best").unionByName(cold.select("row", "n", "count", "best"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = rows.drop("links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
