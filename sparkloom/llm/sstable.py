"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each task streams its range into one shard
file in the shared folder. A shard has

    magic | blocks | index | Bloom filter | footer

A block holds entries (shared key bytes, own key bytes, number of ids, ids) in ascending key order,
each key prefix-compressed against the one before, compressed together and followed by a CRC-32; the
sparse index has each block's first key, place and number of ids; the footer tells where the others
lie. ``Shard.get`` asks the Bloom filter, finds the block by binary search and reads that block
alone. A failed or repeated task leaves a file that no manifest names; only files whose writer
reported back are read.

Words between ASCII white space never share a token in the tokenizers this is made for (checked by the
tests against whole texts), so each distinct word is encoded once a worker.

Defined cases: a null text counts as empty (its only id is the end id); a null identifier sorts
first; repeated identifiers are all kept, ordered by text, and ``get_all`` returns each; an
empty table writes no shard and reads back empty; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import shared_dir, shuffle_partitions, slices

MAGIC = b"LOOMSST1"
FOOTER = struct.Struct("<QQQQQQB7x8s")
ENTRY = struct.Struct("<BBI")
PLACE = struct.Struct("<QIIQB")
BLOCK_BYTES = 1 << 17
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAX_WORDS = 1_000_000
SLICE_BYTES = 4 << 20
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts (UTF-8) as little-endian 32-bit integers.

    A model with a word-end suffix never joins words, and its pre-tokenizer parts the punctuation at a
    word's end from a letter or digit before it. So texts are cut into such pieces, each distinct piece
    (by a 64-bit hash and, from batch to batch, a 32-bit checksum besides, A-Z as a-z) is encoded once by the library, and the ids are put together by
    position, all in arrays. Models without a suffix get whole texts. The tests hold this against
    whole texts.
    """

    def __init__(self, path: str):
        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        made_of = json.loads(self.tok.to_str())
        suffix = made_of["model"].get("end_of_word_suffix")
        if suffix and "Lowercase" not in json.dumps(made_of.get("normalizer") or {}):
            suffix = None  # words are looked up as lower case: a model that tells cases apart gets whole texts
        self.ends = {i for k, i in self.tok.get_vocab().items() if suffix and k.endswith(suffix)}
        self.tail = np.zeros(256, bool)
        self.tail[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True  # without ' < > |, which contractions and special tokens need
        self.firm = np.zeros(256, bool)
        self.firm[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.slot: dict[int, int] = {}
        self.count = 0
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.n, self.sums = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint32)

    def _each(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _encoded(self, words: list[bytes]) -> Iterator[list[int]]:
        """Plain lower-case words go many to a call, cut at the word ends."""
        for at in range(0, len(words), 64):
            part, out, now = words[at : at + 64], [], []
            if all(map(bytes.isalpha, part)):
                for i in self.tok.encode(b" ".join(part).decode(), add_special_tokens=False).ids:
                    now.append(i)
                    if i in self.ends:
                        out.append(now)
                        now = []
            yield from out if len(out) == len(part) and not now else self._each(part)

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        import numpy as np

        order = sorted(range(len(words)), key=lambda i: words[i].isalpha())
        for i, ids in zip(order, self._encoded([words[i] for i in order])):
            k = self.count
            self.count += 1
            if k == len(self.at):
                self.at, self.n, self.sums = (np.resize(x, 2 * k) for x in (self.at, self.n, self.sums))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.slot[hashes[i]], self.at[k], self.n[k], self.sums[k] = k, self.used, len(ids), zlib.crc32(words[i])
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def _pieces(self, joined):
        """(start, end) of each piece, ascending."""
        import numpy as np

        from sparkloom.llm.shingles import IS_SPACE

        space = IS_SPACE[joined]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        cut = ends.copy()  # where the punctuation at the word's end begins
        todo = np.flatnonzero(self.tail[joined[ends - 1]])
        while len(todo):
            cut[todo] -= 1
            todo = todo[cut[todo] > starts[todo]]
            todo = todo[self.tail[joined[cut[todo] - 1]]]
        last, before = joined[cut - 1], joined[cut - 2]
        letter = self.firm[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        two = (cut > starts) & (cut < ends) & letter
        cut = cut[two]
        return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        import numpy as np
        import xxhash

        from sparkloom.llm.shingles import hash_pieces

        if not self.ends:
            return [array("I", ids).tobytes() for ids in self._each(texts)]
        whole = b" " + b" ".join(texts) + b" "
        joined = np.frombuffer(whole, np.uint8)
        starts, ends = self._pieces(joined)
        if not len(starts):
            return [b""] * len(texts)
        h = hash_pieces(joined, starts, ends)
        for i in np.flatnonzero(np.add.reduceat(joined == 60, starts)):  # special tokens keep their case
            h[i] = xxhash.xxh64_intdigest(whole[starts[i] : ends[i]], 9)
        order = np.argsort(h)
        ranked = h[order]
        head = np.append(True, ranked[1:] != ranked[:-1])
        first, u = order[head], ranked[head]
        inverse = np.empty(len(h), np.int32)
        inverse[order] = np.cumsum(head, dtype=np.int32) - 1
        if self.count > MAX_WORDS:
            self.clear()
        names, slot = u.tolist(), self.slot
        words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        words = [w if b"<" in w else w.lower() for w in words]
        # A word that is not the one known by its hash takes its place.
        new = [k for k, x in enumerate(names) if x not in slot or self.sums[slot[x]] != zlib.crc32(words[k])]
        self._learn([names[k] for k in new], [words[k] for k in new])
        s = np.fromiter(map(slot.__getitem__, names), np.int64, len(names))[inverse]
        n = self.n[s]
        total = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[s] - (total - n), n) + np.arange(total[-1])]
        stops = np.cumsum([len(t) + 1 for t in texts])
        bounds = np.append(0, total)[np.searchsorted(starts, stops + 1, "left")] * 4
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *bounds[:-1].tolist()], bounds.tolist())]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def key_of(i: int | None) -> bytes:
    """Byte order is the order of identifiers, null first."""
    return b"\0" if i is None else b"\1" + struct.pack(">Q", i + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Streams entries in key order into an open binary stream; memory holds one block, the index and the keys' hashes."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.zip = out, width, zstandard.ZstdCompressor(level=1)
        self.block: list[bytes] = []
        self.block_bytes = self.block_ids = self.block_entries = 0
        self.first = self.last = b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        self.at = len(MAGIC)
        out.write(MAGIC)

    def add(self, i: int | None, ids: bytes) -> None:
        import numpy as np

        key, n = key_of(i), len(ids) // 4
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        body = ids
        if self.width == 2:
            wide = np.frombuffer(ids, "<u4")
            if n and wide.max() > 0xFFFF:
                raise ValueError(f"id {wide.max()} does not fit into two bytes")
            body = wide.astype("<u2").tobytes()
        self.block += (ENTRY.pack(shared, len(key) - shared, n), key[shared:], body)
        self.block_bytes += len(body) + 16
        self.block_entries += 1
        self.block_ids += n
        self.last = key
        self.keys.append(key)
        if self.block_bytes >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index += (PLACE.pack(self.at, len(data), self.block_entries, self.tokens, len(self.first)), self.first)
            self.at += len(data)
            self.tokens += self.block_ids
            self.block, self.block_bytes, self.block_ids, self.block_entries = [], 0, 0, 0

    def close(self) -> None:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.tokens, self.width, MAGIC))


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shard:
    """Reads one shard file."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.index_at, n, self.bloom_at, self.bits, self.docs, self.tokens, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        raw, p = self.file.read_at(n, self.index_at), 0
        self.firsts, self.places = [], []
        while p < len(raw):
            *place, k = PLACE.unpack_from(raw, p)
            p += PLACE.size
            self.places.append(place)
            self.firsts.append(raw[p : p + k])
            p += k

    def block(self, b: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, number of the shard's ids before it, ids as 32-bit integers) of each entry of a block."""
        import numpy as np
        import zstandard

        at, n, entries, before = self.places[b]
        data = self.file.read_at(n, at)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        data, p, key = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b""
        for _ in range(entries):
            shared, own, count = ENTRY.unpack_from(data, p)
            p += ENTRY.size
            key = key[:shared] + data[p : p + own]
            p += own
            body = data[p : p + count * self.width]
            p += count * self.width
            yield key, before, body if self.width == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes()
            before += count

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        for b in range(len(self.places)):
            yield from self.block(b)

    def may_hold(self, key: bytes) -> bool:
        bloom = self.file.read_at(-(-self.bits // 8), self.bloom_at)
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits))

    def get_all(self, i: int | None) -> list[bytes]:
        """The ids of every document of that identifier."""
        key = key_of(i)
        if not self.may_hold(key):
            return []
        lo, hi = max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)
        return [ids for b in range(lo, hi) for k, _, ids in self.block(b) if k == key]

    def get(self, i: int | None) -> bytes | None:
        return next(iter(self.get_all(i)), None)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", width: int | None = None) -> list[dict]:
    """Writes ``docs`` and returns the manifest: path, docs, tokens, lo, hi of each shard, ascending (one small row a task).

    ``width``: bytes of an id; null: as few as the vocabulary and the end id need.
    """
    import pyarrow as pa

    end = b"" if end_id is None else struct.pack("<I", end_id)
    if width is None:
        width = 2 if max(*encoder(tokenizer).tok.get_vocab().values(), end_id or 0) <= 0xFFFF else 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, lo, hi = None, None, None
        e = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                ids = batch.column(0).to_pylist()
                if writer is None:
                    system, path = filesystem(folder)
                    system.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.sst"
                    writer = ShardWriter(system.open_output_stream(f"{path}/{name}"), width)
                    lo = ids[0]
                for i, x in zip(ids, e.encode([t or b"" for t in batch.column(1).to_pylist()])):
                    writer.add(i, x + end)
                hi = ids[-1]
        if writer is not None:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "docs": len(writer.keys), "tokens": writer.tokens, "lo": lo, "hi": hi}], pa.schema([("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("i").asc_nulls_first()).sortWithinPartitions(F.col("i").asc_nulls_first(), "t")
    told = rows.mapInArrow(work, "path string, docs bigint, tokens bigint, lo bigint, hi bigint").collect()
    return sorted((r.asDict() for r in told), key=lambda r: (r["lo"] is not None, r["lo"] or 0, r["hi"] is not None, r["hi"] or 0))


def read_shards(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row for each document of the shards: id, start, n_tokens, ids_crc32 (and ids with ``keep_ids``)."""
    import pyarrow as pa

    base, todo = 0, []
    for m in manifest:
        todo.append((m["path"], base))
        base += m["tokens"]
    names = [id_col, "start", "n_tokens", "ids_crc32", "ids"][: 4 + keep_ids]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + keep_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                for b in range(len(shard.places)):
                    rows = [(id_of(k), before + at, len(x) // 4, zlib.crc32(x), x) for k, at, x in shard.block(b)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=names)

    paths = spark.createDataFrame(todo, "path string, before bigint").repartition(max(1, len(todo)))
    return paths.mapInArrow(work, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


def op2_sstable(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark).rstrip('/')}/sst-{uuid.uuid4().hex}"
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return read_shards(spark, manifest)
