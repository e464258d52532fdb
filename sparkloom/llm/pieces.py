"""SentencePiece encoding and decoding through a distinct-chunk table.

A model whose pieces hold the white-space marker only at their beginning (checked when it is
loaded) never joins a marked word to the next, so each distinct marked word is segmented, and
decoded, once by the library; a document's ids are the words' ids put together by position. The
table lives as long as its task: every word occurrence stays in the task that read it, nothing is
shuffled, and the table is emptied when it has ``MAX_CHUNKS`` words.

Defined cases: a null text counts as empty and an empty one has the begin and end ids only; words
may be of any length; null ids and repeated rows are rows of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

from sparkloom.llm.common import slices

MARK = "▁"
MAX_CHUNKS = 400_000
SLICE = 256
SLICE_BYTES = 2 << 20


class Coder:
    """Encodes and decodes whole texts exactly as the library would, a distinct word at a time."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.split = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.lone = array("I", [self.sp.piece_to_id(MARK)]).tobytes()
        self.begin, self.end = (array("I", [i]).tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # words whose decoding differs from themselves

    def words(self, text: str) -> list[str]:
        """The marked words, each without its first marker."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        return [w[1:].replace(MARK, " ") for w in re.findall(f"{MARK}+[^{MARK}]*", marked)]

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > MAX_CHUNKS:
            self.ids.clear()
            self.odd.clear()
        new = [w for w in words if w not in self.ids]
        for w, ids, back in zip(new, e := self.sp.encode(new, num_threads=1), self.sp.decode(e)):
            self.ids[w] = array("I", ids).tobytes()
            if back != w:
                self.odd[w] = back
        if "" in words:
            self.ids[""] = self.lone
            self.odd.pop("", None)

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids with begin and end as little-endian 32-bit integers, decoded text) of each text."""
        if not self.split:
            every = self.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            return [(array("I", e).tobytes(), d) for e, d in zip(every, self.sp.decode(every))]
        parts = [self.words(t) for t in texts]
        self.learn(set().union(*parts))
        get, odd, out = self.ids.__getitem__, self.odd, []
        for text, words in zip(texts, parts):
            back = text if MARK not in text else text.replace(MARK, " ")
            if odd and not odd.keys().isdisjoint(words):
                back = " ".join(odd.get(w, w) for w in words)
            out.append((b"".join([self.begin, *map(get, words), self.end]), back))
        return out


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_texts: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with ``keep_texts``)."""
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Coder(model)
        for batch in (part.slice(at, SLICE) for whole in batches for part in slices(whole, SLICE_BYTES) for at in range(0, part.num_rows, SLICE)):
            if batch.num_rows:
                rows = c.encode_decode([t or "" for t in batch.column(1).to_pylist()])
                cols = [
                    batch.column(0),
                    pa.array([len(i) // 4 for i, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in rows], pa.string()),
                ]
                if keep_texts:
                    cols += [pa.array([i for i, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
