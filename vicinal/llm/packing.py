"""Packing by harmonic classes.

A document's ids are cut into whole sequences and a rest. The rest is cut into heads of exactly ``capacity // k`` ids
(the largest such size that fits, again and again) until at most ``capacity // FINEST`` ids are left; these stay one
piece. Class ``k`` holds the pieces of more than ``capacity // (k + 1)`` and at most ``capacity // k`` ids, and each
of its sequences takes exactly ``k`` of them. Every task fills its own sequences; nothing is shuffled. When a task
ends, the pieces in its unfilled sequences follow each other in whole sequences, cut where one is full, and the last
rest goes into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 1
#: Rests of at most capacity / FINEST ids are not cut further: a sequence of such a class is at least FINEST/(FINEST+1) full.
FINEST = 16
#: Entries of a worker's word cache; it is emptied beyond that.
CACHE_WORDS = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"

_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[.,!?|$&%#*;:-]+")
_MARKED = re.compile(r"([a-zß-öø-ÿ])([.,!?|$&%#*;:-])")
_encoders: dict[int, Encoder] = {}


class Encoder:
    """The tokenizer's ids of texts as little-endian bytes, word by word through a bounded cache.

    The tokenizer drops white space, never joins across it and lowers the case, so a text's ids are those of its words
    in order. It also parts letters from the marks behind them: Latin-1 texts are lowered and parted there at once, so
    that few different words are left.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.words: dict[str, bytes] = {"": b""}

    def _learn(self, new: set[str]) -> None:
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            bounds = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(bounds) != len(part):
                raise ValueError("this tokenizer does not end each word of letters or of marks with one </w>")
            raw, begin = ids.tobytes(), 0
            for w, end in zip(part, bounds.tolist(), strict=True):
                self.words[w] = raw[begin:end]
                begin = end
        odd = list(new.difference(plain))
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    @staticmethod
    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
            if "<|" not in text:  # names of special tokens stay as they are
                text = _MARKED.sub(r"\1 \2", text.lower())
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 200):
            split = list(map(self.split, texts[at : at + 200]))
            new = set().union(*split).difference(self.words)
            if new and len(self.words) + len(new) > CACHE_WORDS:
                self.words = {"": b""}
                new = set().union(*split).difference(self.words)
            if new:
                self._learn(new)
            get = self.words.__getitem__
            for words in split:
                yield b"".join(map(get, words))


def encoder(definition: str) -> Encoder:
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def cuts(tokens: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of so many ids."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest > capacity // FINEST:
        head = capacity // -(-capacity // rest)
        out.append(head)
        rest -= head
    return out + [rest] * (rest > 0)


class Packer:
    """The open sequences of one task, and the rows of those that are full."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open, self.rows = capacity, first_id, {}, []

    def add(self, doc_id, raw: bytes) -> None:
        tokens, at = len(raw) // 4, 0
        for length in cuts(tokens, self.capacity):
            piece = (doc_id, at, raw[4 * at : 4 * (at + length)], tokens)
            at += length
            of = self.capacity // length
            mates = self.open.setdefault(of, [])
            mates.append(piece)
            if len(mates) == of:
                self.close(self.open.pop(of))

    def close(self, pieces: list[tuple]) -> None:
        offset, total = 0, sum(len(p[2]) for p in pieces) // 4
        for doc_id, start, raw, tokens in pieces:
            n = len(raw) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(raw), tokens, self.next_id, offset, total))
            offset += n
        self.next_id += 1

    def finish(self) -> None:
        rest = [p for of in sorted(self.open) for p in self.open[of]]
        self.open = {}
        left = sum(len(p[2]) for p in rest) // 4
        sizes = [self.capacity] * (left // self.capacity) + [1 << b for b in reversed(range(self.capacity.bit_length())) if left % self.capacity >> b & 1]
        at = 0
        for size in sizes:
            taken, need = [], size
            while need:
                doc_id, start, raw, tokens = rest[at]
                n = min(need, len(raw) // 4)
                taken.append((doc_id, start, raw[: 4 * n], tokens))
                need -= n
                if 4 * n == len(raw):
                    at += 1
                else:
                    rest[at] = (doc_id, start + n, raw[4 * n :], tokens)
            self.close(taken)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): what it is and where it lies.

    Null and empty texts are the end id alone, a very long one goes over as many sequences as it needs. Repeated rows and equal or null doc_ids are packed each for itself. An
    empty table gives no rows; other columns are not looked at. Memory of a task: one Arrow batch, the cache, and at
    most one open sequence for each class.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(definition), np.array([END_ID], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], columns)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, raw in zip(ids, code.encode(texts), strict=True):
                packer.add(doc_id, raw + end)
            if packer.rows:
                yield out(packer.rows)
                packer.rows = []
        packer.finish()
        if packer.rows:
            yield out(packer.rows)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
