"""Exact Jaccard join of word-shingle sets in the Jaccard metric space.

Distance is 1 - Jaccard likeness, a metric; a link is a distance of at most ``EPS`` = 1/4. Each
different set is a point, named by a 128-bit digest of its content, so copies never meet.

1. *Pivots* are points out of the largest crowds (points that share their two smallest hashes), counted over all
   documents, at any size of input. A point within EPS of pivots lies in the Voronoi region of the nearest one and is
   linked to it. By the triangle inequality, a point linked with one of a region lies within the region's radius
   and EPS of its pivot: the points in that window are replicated to the region, unless they belong to the same
   component of regions.
2. *Points far from every pivot.* Windows say nothing where distances are 1, as they are between most documents. So single shingles
   serve as pivots there: a set lies nearer than 1 to {s} only if it has s. A point of n shingles is replicated to
   those of its first n - ceil(3n/4) + s shingles, in an order that puts shingles frequent in the corpus
   last, with s = min(1 + n // 16, 64). Linked sets share at least the smaller s of such shingles, so no link is lost;
   pairs that share fewer, such as documents with a passage in common, are not compared.
3. *Regions* of both kinds join recursively: pivots of the region, Voronoi cells, windows of each cell's radius and EPS,
   until a cell is small or no longer divides; there overlaps are counted through an inverted index. Points that are
   connected already are not compared; links leave a region as a forest, not as pairs.
4. *Components* of all links are found by minimum labels and pointer jumping over a table of links.

Shingles are compared as 64-bit hashes of whole words. Frequent shingles and crowds are counted
over all documents; they steer the work and never decide a link. To the driver come at most
``MAX_FREQUENT`` frequent shingles, ``MAX_PIVOTS`` pivots of at most ``PIVOT_BYTES``, and a forest of pivots from
each task, whatever the input; all that they leave out is joined by step 2.

Defined cases: a null text counts as empty; a text without words has no shingles, is linked with
nothing and is its own component; null identifiers take part but never name a component that has
others; repeated rows are copies; an empty table gives an empty result; extra columns are ignored
by :func:`components_of` and carried by :func:`one_of_each`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, largest_counts, own_order, packed, shuffle_partitions

NUM, DEN = 75, 100
MAX_FREQUENT = 200_000
MAX_PIVOTS = 1024
PIVOT_BYTES = 24 << 20
EACH = 6
CLOSE = 16
BLOCK = 512
LEAF = 48
#: Distances are carried as whole numbers of this many parts.
PARTS = 1 << 30
SLICE_BYTES = 1 << 18
FLUSH = 1 << 20
HITS = 1 << 19
BROADCAST_ROWS = 1_000_000


def _batches(batches):
    """(ids, texts) slices of bounded size."""
    for whole in batches:
        ids, texts = whole.column(0), whole.column(1).to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or b"") < SLICE_BYTES):
                size += len(texts[end] or b"")
                end += 1
            yield ids.slice(at, end - at), [t or b"" for t in texts[at:end]]
            at = end


def _scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: (kind, key, n, sid, name, h, set).

    Kind 2: a row for each document (key: identifier, n: size of its set, sid and name, h: the text's MD5, set: the crowd, its two smallest
    hashes together). Kind 0: n packed shingles that come often among a task's different sets, with their counts (set).
    """
    import pyarrow as pa

    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("name", pa.binary()), ("h", pa.binary()), ("set", pa.binary())])

    def often(values):
        import numpy as np

        u, c = np.unique(np.concatenate(values), return_counts=True)
        u, c = u[c > 1], c[c > 1]
        for at in range(0, len(u), 1 << 16):
            k, n = u[at : at + (1 << 16)], c[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.array([len(k)], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([k.tobytes() + n.astype("<u4").tobytes()], pa.binary())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from sparkloom.llm.shingles import Sets

        md5 = partial(hashlib.md5, usedforsecurity=False)
        values, held, seen = [], 0, set()
        for ids, texts in _batches(batches):
            sets = Sets(texts)
            k = len(texts)
            has = sets.sizes > 0
            crowd = [sets[j][:2].sum().tobytes() if has[j] else None for j in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, 2, np.int32)), ids.cast(pa.int64()), pa.array(sets.sizes.astype(np.int64)), pa.array(sets.sid, mask=~has), pa.array([s if x else None for s, x in zip(sets.names, has)], pa.binary()), pa.array([md5(t).digest() for t in texts], pa.binary()), pa.array(crowd, pa.binary())], schema=schema)
            for j in np.flatnonzero(has):
                if sets.names[j] not in seen:
                    seen.add(sets.names[j])
                    values.append(sets[j])
                    held += len(sets[j])
            if held >= 2 * FLUSH:
                yield from often(values)
                values, held = [], 0
        if values:
            yield from often(values)

    return docs.mapInArrow(work, "kind int, key bigint, n bigint, sid bigint, name binary, h binary, set binary")


def _shingle_counts(base: DataFrame) -> DataFrame:
    """(key, n) of the packed counts."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64, n)), pa.array(np.frombuffer(x, np.uint32, n, 8 * n).astype(np.int64))], names=["key", "n"])

    return base.where("kind = 0").select("n", "set").mapInArrow(work, "key bigint, n bigint")


def _distinct_sets(docs: DataFrame) -> DataFrame:
    """(sid, name, set) of the non-empty sets; one that has copies may come once from each task."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkloom.llm.shingles import Sets

        seen: set[bytes] = set()
        for _, texts in _batches(batches):
            sets = Sets(texts)
            rows = []
            for j, (s, name) in enumerate(zip(sets.sid.tolist(), sets.names)):
                if name not in seen and sets.sizes[j]:
                    seen.add(name)
                    rows.append((s, name, sets[j].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["sid", "name", "set"])

    return docs.mapInArrow(work, "sid bigint, name binary, set binary")


def _pivots(src: DataFrame, points: DataFrame) -> list[tuple[bytes, bytes]]:
    """Up to ``MAX_PIVOTS`` points, ``EACH`` of a crowd, the largest crowds first: (name, set)."""
    free = points.where("name is not null").groupBy("crowd", "name").agg(F.first("n").alias("n"), F.min("h").alias("h"))
    crowds = largest_counts(cut(free.groupBy("crowd").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")), "c", MAX_PIVOTS // EACH)
    w = Window.partitionBy("crowd").orderBy("name")
    some = free.join(F.broadcast(crowds), "crowd").withColumn("r", F.row_number().over(w)).where(F.col("r") <= EACH)
    chosen, size = {}, 0
    for r in sorted(some.select("c", "crowd", "r", "name", "n", "h").collect(), key=lambda r: (-r["c"], bytes(r["crowd"]), r["r"])):
        if len(chosen) < MAX_PIVOTS and size + 8 * r["n"] <= PIVOT_BYTES:
            size += 8 * r["n"]
            chosen[bytes(r["h"])] = bytes(r["name"])
    if not chosen:
        return []
    few = src.sparkSession.createDataFrame([(bytearray(h),) for h in chosen], "h binary")
    texts = src.join(F.broadcast(few), F.unhex(F.md5("t")) == F.col("h"), "left_semi")
    sets = {bytes(r["name"]): bytes(r["set"]) for r in _distinct_sets(texts).dropDuplicates(["name"]).select("name", "set").collect()}
    return _apart([(name, sets[name]) for name in chosen.values()])


def _apart(pivots: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """The pivots, in order, without those that ``CLOSE`` earlier ones lie within twice EPS of: a point comes in few windows, however large its crowd."""
    import numpy as np

    sets = [np.frombuffer(s, np.uint64) for _, s in pivots]
    index, close, stay = _Pivots(sets), np.zeros(len(sets), np.int64), []
    for k, s in enumerate(sets):
        if close[k] < CLOSE:
            stay.append(pivots[k])
            close[index.near(_One(s))[1]] += 1
    return stay


class _One:
    """A single set as a batch of sets."""

    def __init__(self, values):
        import numpy as np

        self.values, self.doc, self.sizes = values, np.zeros(len(values), np.int64), np.array([len(values)])


class _Pivots:
    """The pivots' inverted index."""

    def __init__(self, sets: list):
        import numpy as np

        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.values, self.owner = every[order], owner[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[every & np.uint64((1 << 22) - 1)] = True

    def near(self, sets):
        """(set, pivot, distance, linked) of all pairs within twice the distance of a link."""
        import numpy as np

        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        if len(self.values):
            maybe = self.seen[sets.values & np.uint64((1 << 22) - 1)]
            v, d = sets.values[maybe], sets.doc[maybe]
            lo, hi = np.searchsorted(self.values, v, "left"), np.searchsorted(self.values, v, "right")
            hit = hi > lo
            lo, n, d = lo[hit], (hi - lo)[hit], d[hit]
            per_doc = np.bincount(d, n, len(sets.sizes)).cumsum() if len(n) else np.zeros(1)
            begin = 0
            while begin < len(n):  # whole documents, of bounded hits together
                until = np.searchsorted(per_doc, (per_doc[d[begin] - 1] if d[begin] else 0) + HITS, "right")
                end = max(int(np.searchsorted(d, until, "left")), int(np.searchsorted(d, d[begin], "right")))
                out.append(self._counted(sets, lo[begin:end], n[begin:end], d[begin:end]))
                begin = end
        return tuple(np.concatenate(c) for c in zip(*out))

    def _counted(self, sets, lo, n, d):
        import numpy as np

        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        pair, both = np.unique(np.repeat(d, n) * len(self.sizes) + self.owner[at], return_counts=True)
        d, p = pair // len(self.sizes), pair % len(self.sizes)
        union = sets.sizes[d] + self.sizes[p] - both
        near = 2 * both >= union
        d, p, both, union = d[near], p[near], both[near], union[near]
        return d, p, (union - both) * PARTS // union, DEN * both >= NUM * union


def _near_pivots(docs: DataFrame, pivots) -> DataFrame:
    """(name, sid, key, d, linked): the points within twice EPS of a pivot ``key``, once a task, with their distances."""
    import pyarrow as pa

    schema = pa.schema([("name", pa.binary()), ("sid", pa.int64()), ("key", pa.int64()), ("d", pa.int64()), ("linked", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from sparkloom.llm.shingles import Sets

        index = _Pivots([np.frombuffer(s, np.uint64) for s in pivots.value])
        seen: set[bytes] = set()
        for _, texts in _batches(batches):
            sets = Sets(texts)
            d, p, distance, linked = index.near(sets)
            new = np.zeros(len(texts), bool)
            for j in np.unique(d):
                new[j] = sets.names[j] not in seen
                seen.add(sets.names[j])
            keep = new[d]
            d, p, distance, linked = d[keep], p[keep], distance[keep], linked[keep]
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array([sets.names[j] for j in d], pa.binary()), pa.array(sets.sid[d]), pa.array(p), pa.array(distance), pa.array(linked)], schema=schema)

    return docs.mapInArrow(work, "name binary, sid bigint, key bigint, d bigint, linked boolean")


def _forest(pairs: DataFrame, size: int) -> dict[int, int]:
    """Which of ``size`` pivots the pairs (a, b) connect, as pointers; each task sends a forest of the pivots at most."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = _root(a, up), _root(b, up)
                if a != b:
                    up[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(list(up.values()), pa.int64())], names=["a", "b"])

    up: dict[int, int] = {}
    for a, b in pairs.distinct().mapInArrow(work, "a bigint, b bigint").collect():
        a, b = _root(a, up), _root(b, up)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {k: _root(k, up) for k in range(size)}


def _postings(docs: DataFrame, pivots, frequent, buckets: int) -> DataFrame:
    """(bucket, postings): for each point that no pivot took, its first shingles; packed (32-bit key, sid) arrays."""
    import pyarrow as pa

    schema = pa.schema([("bucket", pa.int32()), ("postings", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from sparkloom.llm.shingles import Sets, mix

        index = _Pivots([np.frombuffer(s, np.uint64) for s in pivots.value])
        often, counts = (np.frombuffer(x, np.uint64) for x in frequent.value)
        maybe = np.zeros(1 << 20, bool)
        maybe[often & np.uint64((1 << 20) - 1)] = True
        seen, keys, sids, held = set(), [], [], 0

        def flush():
            k, s = np.concatenate(keys), np.concatenate(sids)
            k = mix(k ^ np.uint64(0x5851F42D4C957F2D))
            b = ((k >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            k, s, b = k[order].astype(np.uint32), s[order], b[order]
            cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            ends = np.append(cuts[1:], len(b))
            blobs = [k[i:j].tobytes() + s[i:j].tobytes() for i, j in zip(cuts, ends)]
            for at in range(0, len(blobs), 512):
                yield pa.RecordBatch.from_arrays([pa.array(b[cuts[at : at + 512]].astype(np.int32)), pa.array(blobs[at : at + 512], pa.binary())], schema=schema)

        for _, texts in _batches(batches):
            sets = Sets(texts)
            d, _, _, linked = index.near(sets)
            skip = np.zeros(len(texts), bool)
            skip[d[linked]] = True
            for j, name in enumerate(sets.names):
                if name in seen or not sets.sizes[j]:
                    skip[j] = True
                seen.add(name)
            place = np.arange(len(sets.values)) - np.repeat(sets.bounds[:-1], sets.sizes)
            if len(often):  # frequent shingles go behind the others of their set, by their counts
                m = np.flatnonzero(maybe[sets.values & np.uint64((1 << 20) - 1)])
                at = np.minimum(np.searchsorted(often, sets.values[m]), len(often) - 1)
                hit = often[at] == sets.values[m]
                m, rank = m[hit], counts[at[hit]]
                before = np.cumsum(np.bincount(m, minlength=len(place))) if len(m) else np.zeros(len(place), np.int64)
                until = np.append(0, before)[sets.bounds[:-1]]
                place = place - (before - np.repeat(until, sets.sizes))
                m = m[np.lexsort((sets.values[m], rank, sets.doc[m]))]
                rare = sets.sizes - np.bincount(sets.doc[m], minlength=len(texts))
                begin = np.flatnonzero(np.append(True, sets.doc[m][1:] != sets.doc[m][:-1])) if len(m) else np.zeros(0, np.int64)
                place[m] = rare[sets.doc[m]] + np.arange(len(m)) - np.repeat(begin, np.diff(np.append(begin, len(m))))
            first = sets.sizes - -(-NUM * sets.sizes // DEN) + sets.share
            use = (place < first[sets.doc]) & ~skip[sets.doc]
            keys.append(sets.values[use])
            sids.append(sets.sid[sets.doc[use]])
            held += int(use.sum())
            if held >= FLUSH:
                yield from flush()
                keys, sids, held = [], [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(work, "bucket int, postings binary")


def _candidates(postings: DataFrame, partitions: int) -> DataFrame:
    """(a, b, c, region, side): region null: the pair a < b shares c first shingles of a bucket; else point a takes part in that region's block pair."""
    import pyarrow as pa

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32()), ("region", pa.int64()), ("side", pa.int32())])

    def joined(blobs: list[bytes]):
        import numpy as np

        from sparkloom.llm.shingles import mix

        ks = [np.frombuffer(x, np.uint32, len(x) // 12) for x in blobs]
        ss = [np.frombuffer(x, np.int64, len(x) // 12, 4 * (len(x) // 12)) for x in blobs]
        k, s = np.concatenate(ks), np.concatenate(ss)
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        new = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
        k, s = k[new], s[new]
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        n = np.diff(np.append(heads, len(k)))
        pairs = [np.zeros((0, 2), np.int64)]
        for m in np.unique(n[(n > 1) & (n <= 64)]):
            at = s[heads[n == m][:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            pairs.append(np.stack([at[:, i].ravel(), at[:, j].ravel()], 1))
        told = set()
        for h, m in zip(heads[n > 64], n[n > 64]):
            members = s[h : h + m]
            name = int(mix(mix(members.view(np.uint64)).sum(keepdims=True)).view(np.int64)[0])
            if name not in told:
                told.add(name)
                for region, points, side in _blocks(name, members):
                    k = len(points)
                    yield pa.RecordBatch.from_arrays([pa.array(points), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(np.full(k, region)), pa.array(np.full(k, side, np.int32))], schema=schema)
        found = np.concatenate(pairs)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        head = np.flatnonzero(np.append(True, (found[1:] != found[:-1]).any(1)))[: len(found)]
        times = np.diff(np.append(head, len(found))).astype(np.int32)
        for at in range(0, len(head), 100_000):
            some = found[head[at : at + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(times[at : at + 100_000]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int32())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != now and held:
                    yield from joined(held)
                    held = []
                now = b
                held.append(x)
        if held:
            yield from joined(held)

    dealt = postings.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, "a bigint, b bigint, c int, region bigint, side int")


def _blocks(name: int, members):
    """(region, points, side) that put each block of ``members`` with each other; side 1 is left, 2 right, 3 both."""
    parts = [members[i : i + BLOCK] for i in range(0, len(members), BLOCK)]
    for i, x in enumerate(parts):
        for j in range(i, len(parts)):
            region = hash((name, i, j)) & ((1 << 62) - 1)
            if i == j:
                yield region, x, 3
            else:
                yield region, x, 1
                yield region, parts[j], 2


def _sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(region, name, side, set): ``members`` with their sets, broadcast up to ``BROADCAST_ROWS`` rows, shuffled by point beyond.

    A point may come once from each task that read a copy of it.
    """
    small = members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return _distinct_sets(docs).join(F.broadcast(members) if small else members, "sid").select("region", "name", "side", "set")


class _Region:
    """The sets of a region; ``links`` has a forest of all links between its sides."""

    def __init__(self, rows: list[tuple[bytes, int, bytes]]):
        import numpy as np

        merged: dict[bytes, list] = {}
        for name, side, x in rows:
            merged[name] = [merged.get(name, [0])[0] | side, x]
        self.names = list(merged)
        self.sets = [np.frombuffer(x, np.uint64) for _, x in merged.values()]
        side = np.array([s for s, _ in merged.values()])
        self.size = np.array([len(x) for x in self.sets])
        self.of = np.arange(len(self.names))  # the component of each point, as far as found
        self.links: list[tuple[bytes, bytes]] = []
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        if len(left) and len(right):
            self.parts = [self._index(left)] + ([self._index(right)] if (side != 3).any() else [])
            self._join(left, right)

    def _index(self, some):
        import numpy as np

        every, owner = np.concatenate([self.sets[i] for i in some]), np.repeat(some, self.size[some])
        order = np.argsort(every, kind="stable")
        return every[order], owner[order]

    def _overlaps(self, j: int, parts):
        """How many shingles set ``j`` shares with each set of the inverted indexes ``parts``."""
        import numpy as np

        both = np.zeros(len(self.names), np.int64)
        for every, owner in parts:
            lo, hi = np.searchsorted(every, self.sets[j], "left"), np.searchsorted(every, self.sets[j], "right")
            n = hi - lo
            at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            both = np.maximum(both, np.bincount(owner[at], minlength=len(both)))
        return both

    def _link(self, j: int, both, some) -> None:
        """Connects ``j`` with those of ``some`` that lie within EPS and are not connected with it yet."""
        import numpy as np

        union = self.size[some] + self.size[j] - both[some]
        for i in some[(DEN * both[some] >= NUM * union) & (self.of[some] != self.of[j])]:
            if self.of[i] != self.of[j]:
                self.links.append((self.names[i], self.names[j]))
                self.of[self.of == self.of[i]] = self.of[j]

    def _join(self, left, right) -> None:
        import numpy as np

        cells = list(self._cells(left, right))
        partners: dict[int, list] = {}
        for some, others in cells:
            for j in others:
                partners.setdefault(int(j), []).append(some)
        for j, some in partners.items():
            some = np.concatenate(some)
            some = some[self.of[some] != self.of[j]]
            if len(some):
                self._link(j, self._overlaps(j, self.parts[:1]), some)

    def _cells(self, left, right):
        """(points of ``left``, points of ``right`` they are to be compared with): Voronoi cells and their windows, in recursion."""
        import numpy as np

        if len(left) * len(right) <= LEAF * LEAF or not (self.of[left, None] != self.of[right]).any():
            yield left, right
            return
        pivots = left[np.linspace(0, len(left) - 1, 8).astype(int)]
        distance = np.empty((len(pivots), len(self.names)))
        for k, p in enumerate(pivots):
            both = self._overlaps(p, self.parts)
            distance[k] = 1 - both / (self.size + self.size[p] - both)
            self._link(p, both, np.append(left, right))
        home = distance[:, left].argmin(0)
        for k in range(len(pivots)):
            cell = left[home == k]
            if len(cell):
                window = right[distance[k, right] <= distance[k, cell].max() + 1 - NUM / DEN + 1e-9]
                if len(cell) * len(window) * 2 > len(left) * len(right):  # does not divide
                    yield cell, window
                elif len(window):
                    yield from self._cells(cell, window)


def _linked(rows: DataFrame, partitions: int) -> DataFrame:
    """Links (u, v) that span, in each region, the components of all links between its sides."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.binary()), pa.array([v for _, v in links], pa.binary())], names=["u", "v"])

        for batch in batches:
            for r, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r != now and held:
                    yield out(_Region(held).links)
                    held = []
                now = r
                held.append(row)
        if held:
            yield out(_Region(held).links)

    return rows.repartition(partitions, "region").sortWithinPartitions("region").mapInArrow(work, "u binary, v binary")


def _least_shared(n, m):
    """So many first shingles sets of these sizes share at least if they are linked.

    Linked sets have an overlap of at least NUM (n + m) / (NUM + DEN); of a set's shingles all but the first lie behind
    its prefix, so the overlap's first shingles, as many as it has more than those behind, lie in both prefixes.
    """
    behind = lambda k: F.ceil(k * NUM / DEN) - F.least(1 + F.floor(k / 16), F.lit(64))
    return F.ceil((n + m) * NUM / (NUM + DEN)) - F.greatest(behind(n), behind(m))


def _pair_regions(pairs: DataFrame) -> DataFrame:
    """(region, sid, side): pairs gathered by the smallest point next to either end, dealt into blocks where many meet."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    least = ends.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("g"))
    p = pairs.join(least.select(F.col("x").alias("a"), F.col("g").alias("ga")), "a").join(least.select(F.col("x").alias("b"), F.col("g").alias("gb")), "b")
    p = p.select("a", "b", F.least("ga", "gb").alias("g"))
    # 2,048 pairs a block pair, on average
    counts = p.groupBy("g").agg(F.count(F.lit(1)).alias("c")).select(F.col("g").alias("h"), F.ceil(F.sqrt(F.col("c") / 2048)).cast("int").alias("k"))
    p = p.join(counts, p.g == counts.h)
    region = F.xxhash64("g", F.pmod(F.xxhash64("a"), F.col("k")), F.pmod(F.xxhash64("b"), F.col("k")))
    p = p.select(region.alias("region"), "a", "b")
    members = p.select("region", F.col("a").alias("sid"), F.lit(1).alias("side")).union(p.select("region", "b", F.lit(2)))
    return members.distinct()


def _windows(ball: DataFrame, shell: DataFrame) -> DataFrame:
    """(region, sid, side): each block of a component's regions with each block of its windows; both sides (key, sid)."""
    size = ball.groupBy("key").agg(F.count(F.lit(1)).alias("nb")).join(shell.groupBy("key").agg(F.count(F.lit(1)).alias("ns")), "key")
    size = size.select("key", F.ceil(F.col("nb") / BLOCK).alias("kb"), F.ceil(F.col("ns") / BLOCK).alias("ks"))
    region = lambda i, j: F.xxhash64("key", i, j, F.lit("w"))
    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    b = ball.join(F.broadcast(size), "key").withColumn("i", F.pmod(F.xxhash64("sid"), F.col("kb"))).withColumn("j", upto("ks"))
    s = shell.join(F.broadcast(size), "key").withColumn("j", F.pmod(F.xxhash64("sid"), F.col("ks"))).withColumn("i", upto("kb"))
    return b.select(region(F.col("i"), F.col("j")).alias("region"), "sid", F.lit(1).alias("side")).union(s.select(region(F.col("i"), F.col("j")), "sid", F.lit(2)))


def connected(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node that links reach, for all nodes with links."""
    both = links.where("u <> v")
    both = cut(both.select("u", "v").union(both.select("v", "u")).distinct())
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    for _ in range(most_rounds):
        heard = both.join(label.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("m"))
        less = label.join(heard, label.node == heard.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        jump = less.join(label.select(F.col("node").alias("jn"), F.col("label").alias("jl")), F.col("l") == F.col("jn"), "left")
        new = cut(jump.select("node", "old", F.least("l", F.coalesce("jl", "l")).alias("label")))
        label = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def _root(i: int, up: dict[int, int]) -> int:
    while up.get(i, i) != i:
        i = up[i]
    return i


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id."""
    out = _components(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _regions_of_pivots(src: DataFrame, points: DataFrame):
    """(pivots' sets, root, members): root (s, pivot) has the points that a pivot took with the name of the pivot that stands for
    their component; members (region, sid, side) deals regions and windows into blocks. root and members are None without pivots."""
    spark = src.sparkSession
    pivots = _pivots(src, points)
    if not pivots:
        return [], None, None
    near = cut(_near_pivots(src, spark.sparkContext.broadcast([s for _, s in pivots])))
    # The nearest pivot of a point within EPS of some is its home; the first of equally near ones.
    ball = near.where("linked").select("name", "sid", "key", (F.col("d") * 4096 + F.col("key")).alias("dk")).distinct()
    home = cut(ball.groupBy("name", "sid").agg(F.min("dk").alias("dk")).select("name", "sid", (F.col("dk") % 4096).alias("home"), F.floor(F.col("dk") / 4096).alias("d")))
    # Pivots within EPS of one point are in one component.
    of = _forest(ball.join(home.select("name", "home"), "name").where("key <> home").select("key", "home"), len(pivots))
    comp = spark.createDataFrame([(k, c, bytearray(pivots[c][0])) for k, c in of.items()], "key bigint, comp int, pivot binary")
    radius = home.groupBy("home").agg(F.max("d").alias("radius"))
    region = F.broadcast(cut(comp.join(radius, F.col("key") == F.col("home"), "left").select("key", "comp", "pivot", F.coalesce("radius", F.lit(0)).alias("radius")).coalesce(1)))
    root = cut(home.join(region, F.col("home") == F.col("key")).select(F.col("name").alias("s"), "sid", F.col("comp").alias("own"), "pivot"))
    shell = near.where("not linked").select("name", "sid", "key", "d").distinct().join(region, "key")
    shell = shell.where(F.col("d") <= F.col("radius") + PARTS // 4 + 4)  # distances are rounded down
    shell = shell.join(root.select("s", "own"), F.col("name") == F.col("s"), "left").where("own is null or own <> comp")
    # Regions of one component are joined as one: its points and those in any of its windows, each sent once a block.
    members = _windows(root.select(F.col("own").alias("key"), "sid"), cut(shell.select(F.col("comp").alias("key"), "sid").distinct()))
    return [s for _, s in pivots], root.select("s", "pivot"), members


def _components(src: DataFrame) -> DataFrame:
    """(id, n, name, h, label, component) of ``src`` (id, t): the set's name, a digest of the text, the component's own name and its smallest id.

    name, label and component are null where there are no shingles, component also where no row of it has an id.
    """
    import numpy as np

    spark = src.sparkSession
    parts = shuffle_partitions(spark)
    base = cut(_scan(src))
    points = base.where("kind = 2").select(F.col("key").alias("id"), "n", "sid", "name", "h", F.col("set").alias("crowd"))
    top = largest_counts(_shingle_counts(base).groupBy("key").agg(F.sum("n").alias("c")).where("c >= 8"), "c", MAX_FREQUENT).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order].tobytes(), top["c"].to_numpy(np.int64).astype(np.uint64)[order].tobytes()))
    pivots, root, members = _regions_of_pivots(src, points)
    shared = spark.sparkContext.broadcast(pivots)

    met = _candidates(_postings(src, shared, frequent, parts * 4), parts)
    met = met.groupBy("a", "b", "region", "side").agg(F.sum("c").alias("c"))
    enough = F.least(F.col("a").bitwiseAND(63), F.col("b").bitwiseAND(63)) + 1
    candidates = cut(met.where(F.col("region").isNotNull() | (F.col("c") >= enough)))
    # The first half of a name steers the search only: where different sets share it, their size is left open.
    size = points.where("name is not null").groupBy("sid").agg(F.min("n").alias("least"), F.max("n").alias("n"))
    size = size.select("sid", F.when(F.col("least") == F.col("n"), F.col("n")).alias("n"))
    pairs = candidates.where("region is null").select("a", "b", "c")
    for end in ("a", "b"):
        pairs = pairs.join(size.select(F.col("sid").alias(end), F.col("n").alias(f"n{end}")), end)
    pairs = cut(pairs.where(F.coalesce(F.col("c") >= _least_shared(F.col("na"), F.col("nb")), F.lit(True))).select("a", "b"))
    regions = candidates.where("region is not null").select("region", F.col("a").alias("sid"), "side")
    every = _pair_regions(pairs).union(regions)
    every = cut(every.union(members) if members is not None else every)
    edges = _linked(_sets_of(src, every), parts).distinct()
    if root is not None:  # points of a pivot's component stand for it
        for end in ("u", "v"):
            edges = edges.join(root.select(F.col("s").alias(end), "pivot"), end, "left").withColumn(end, F.coalesce("pivot", end)).drop("pivot")
        edges = edges.distinct()
    label = connected(edges)

    least = points.where("name is not null").groupBy("name").agg(F.min("id").alias("first"))
    if root is not None:
        least = least.join(root, F.col("name") == F.col("s"), "left").select("name", "first", F.coalesce("pivot", "name").alias("point"))
    else:
        least = least.withColumn("point", F.col("name"))
    least = least.join(label, F.col("point") == F.col("node"), "left").select("name", "first", F.coalesce("label", "point").alias("label"))
    named = least.groupBy("label").agg(F.min("first").alias("component"))
    of = cut(least.join(named, "label").select(F.col("name").alias("s"), "label", "component"))
    points = points.drop("crowd", "sid")
    alone = points.where("name is null").select("*", F.lit(None).cast("binary").alias("label"), F.lit(None).cast("long").alias("component"))
    return points.join(of, F.col("name") == F.col("s")).drop("s").union(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one document with the smallest identifier, with all columns; one without identifier stays only where no row of the component has one.

    A document is known by its identifier and its text, so that rows that share an identifier, or have none, stay apart.
    Texts without shingles are linked with nothing and all stay.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    found = _components(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")))
    linked = found.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("o"), "id", "h")).alias("m")).select("m.id", "m.h", F.lit(True).alias("__k"))
    alone = found.where("label is null").select("id", "h", F.lit(False).alias("__k")).distinct()
    stay = linked.union(alone).select(F.col("id").alias("__i"), F.col("h").alias("__h"), "__k")
    rows = packed(docs, i=F.col(id_col).cast("long"), h=F.unhex(F.md5(text)))
    rows = rows.join(stay, rows.i.eqNullSafe(stay["__i"]) & (rows.h == stay["__h"]))
    once = Window.partitionBy("__i", "__h").orderBy(own_order(rows))
    rows = rows.withColumn("nth", F.when(F.col("__k"), F.row_number().over(once)).otherwise(1))
    return rows.where("nth = 1").select("row.*")


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
