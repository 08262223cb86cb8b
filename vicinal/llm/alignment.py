"""Cross-tokenizer alignment.

Each Arrow batch is encoded by both tokenizers and becomes two interval tables of tokens in an in-memory DuckDB. There an
equality join of ends finds where both tokenizers cut, a window over the cuts tells where each group begins in a text's
digest, ASOF joins give every token its group, and a range join inside groups finds overlaps where these are asked for.
Counts of linked pairs are partial for each chunk of texts; Spark adds them up, and each chunk gets back the counts of its
own pairs only. Texts are encoded once: what is left of them are the pairs of each text, as places in its chunk's list.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import small_side, stored

#: Bytes of text in a DuckDB table and, about, in a chunk.
SLICE_BYTES = 1_000_000
CHUNK_BYTES = 8_000_000

FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
ENCODED = f"chunk long, {FIELDS}, links binary, pairs array<long>, counts array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

#: Cuts: ends that both tokenizers have. ``last_a`` and ``last_b`` are the tokens that end there; where groups follow one
#: another, each with its A tokens first, those of A stand ``before_b`` places further on and those of B ``to_a``.
CUTS = """
CREATE OR REPLACE TEMP TABLE cuts AS
SELECT *, last_a + 1 AS to_a, coalesce(lag(last_b) OVER (ORDER BY stop), -1) + 1 AS before_b
FROM (SELECT stop, a.k AS last_a, b.k AS last_b, a.id AS a, b.id AS b FROM tokens_a a JOIN tokens_b b USING (stop))
"""
#: The place of each token: its group ends at the first cut that is not before the token's end.
PLACED = """
SELECT t.k, t.k + c.{other} AS place, t.stop = c.stop AS ends FROM tokens_{side} t ASOF JOIN cuts c ON t.stop <= c.stop
"""
LINKS = {
    "end": "SELECT last_a AS k, a, b FROM cuts",
    "overlap": """
        WITH a AS (SELECT t.*, c.to_a AS g FROM tokens_a t ASOF JOIN cuts c ON t.stop <= c.stop), b AS (SELECT t.*, c.to_a AS g FROM tokens_b t ASOF JOIN cuts c ON t.stop <= c.stop)
        SELECT a.k, a.id AS a, b.id AS b FROM a JOIN b ON a.g = b.g AND a.start < b.stop AND b.start < a.stop""",
}


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """The vocabulary of a byte-level BPE file: its merges are numbered in their order, so ids are ranks."""

    #: Fixed: how byte-level BPE cuts a text into words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.encoding = tiktoken.Encoding("byte level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A sentencepiece model; it puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.pieces = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """One tokenizer's tokens of some texts, as flat arrays."""

    def __init__(self, tokenizer: ByteBpe | Pieces):
        self.tokenizer = tokenizer
        self.bytes = pa.array(tokenizer.pieces, pa.binary())
        self.lengths = np.array([len(p) for p in tokenizer.pieces], np.int64)
        #: Each id's digits followed by nothing, a comma, a bar, a semicolon.
        self.digits = pa.array([f"{i}{mark}" for i in range(len(tokenizer.pieces)) for mark in ("", ",", "|", ";")], pa.binary())

    def encoded(self, texts: list[str], wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, numbers of tokens, whether tokens say the text again)."""
        lists = self.tokenizer.encode(texts)
        counts = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
        joined = self.bytes.take(pa.array(ids))
        data = memoryview(joined.buffers()[2] or b"").cast("B")  # Arrow says signed bytes
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))[np.concatenate(([0], np.cumsum(counts)))]
        same = [data[a:b] == w for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), wanted, strict=True)]
        return ids, counts, np.array(same, bool)

    def table(self, ids: np.ndarray) -> pa.Table:
        stop = np.cumsum(self.lengths[ids])
        return pa.table({"k": np.arange(len(ids)), "id": ids, "start": stop - self.lengths[ids], "stop": stop})


class Aligner:
    def __init__(self, byte_path: str, piece_path: str, links: str):
        import duckdb

        self.sides, self.links = (Side(ByteBpe(byte_path)), Side(Pieces(piece_path))), links
        self.db = duckdb.connect(config={"threads": "1", "temp_directory": ""})

    def rows(self, texts: list[str]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """(columns, pairs, bounds): text k has the linked pairs [bounds[k], bounds[k + 1]), as a id << 32 | b id."""
        wanted = [(" " + t).encode() for t in texts]
        encoded = [side.encoded(texts, wanted) for side in self.sides]
        good = encoded[0][2] & encoded[1][2] & np.array([len(w) > 1 for w in wanted])
        out = {"n_a": np.zeros(len(texts), np.int64), "n_b": np.zeros(len(texts), np.int64), "n_groups": np.zeros(len(texts), np.int64)}
        digests, bounds = [""] * len(texts), np.zeros(len(texts) + 1, np.int64)
        if not good.any():
            return out | {"n_links": np.diff(bounds), "groups": digests}, np.zeros(0, np.int64), bounds
        ids = [x[0][np.repeat(good, x[1])] for x in encoded]
        for name, x in zip(("n_a", "n_b"), encoded, strict=True):
            out[name][good] = x[1][good]
        first = np.concatenate(([0], np.cumsum(out["n_a"])))
        for name, side, x in zip("ab", self.sides, ids, strict=True):
            self.db.register(f"tokens_{name}", side.table(x))
        self.db.execute(CUTS)
        groups = np.searchsorted(np.sort(self.db.execute("SELECT last_a FROM cuts").fetchnumpy()["last_a"]), first)
        out["n_groups"] = np.diff(groups)
        n = len(ids[0]) + len(ids[1])
        id_, b, ends = np.empty(n, np.int64), np.zeros(n, bool), np.empty(n, bool)
        for side, other in (("a", "before_b"), ("b", "to_a")):
            placed = self.db.execute(PLACED.format(side=side, other=other)).fetchnumpy()
            place = placed["place"]
            id_[place], ends[place], b[place] = ids[side == "b"][placed["k"]], placed["ends"], side == "b"
        mark = np.where(ends, np.where(b, 3, 2), 1)
        tokens = first + np.concatenate(([0], np.cumsum(out["n_b"])))
        mark[tokens[1:][good] - 1] = 0
        # Both vocabularies' digits in one array: A's ids come first.
        digits = pa.chunked_array([s.digits for s in self.sides]).combine_chunks()
        said = digits.take(pa.array((id_ + b * len(self.sides[0].lengths)) * 4 + mark))
        data, places = memoryview(said.buffers()[2]), np.frombuffer(said.buffers()[1], np.int32, len(said) + 1)[tokens].tolist()
        for k in np.flatnonzero(good).tolist():
            digests[k] = hashlib.sha256(data[places[k] : places[k + 1]]).hexdigest()
        linked = self.db.execute(LINKS[self.links]).fetchnumpy()
        text = np.searchsorted(first, linked["k"], side="right") - 1
        order = np.argsort(text, kind="stable")
        pairs = (linked["a"].astype(np.int64) << 32 | linked["b"].astype(np.int64))[order]
        bounds = np.searchsorted(text[order], np.arange(len(texts) + 1))
        return out | {"n_links": np.diff(bounds), "groups": digests}, pairs, bounds


def runs_of(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (text, value), with their counts."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(first)
    return text[starts], value[starts], np.diff(np.append(starts, len(text)))


def encode(byte_path: str, piece_path: str, links: str):
    """Rows of texts, and one row for each chunk with its distinct pairs. A text's links are the places of its pairs in the
    chunk's list, as steps from one to the next, and then how often it has each."""

    def flush(chunk: int, held: list[tuple[pa.Array, dict, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        pairs, index, counts = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True, return_counts=True)
        names = [f.split()[0] for f in ENCODED.split(", ")]
        at = 0
        for ids, columns, found, bounds in held:
            text, place, n = runs_of(np.repeat(np.arange(len(ids)), np.diff(bounds)), index[at : at + len(found)])
            at += len(found)
            edges = np.searchsorted(text, np.arange(len(ids) + 1)).tolist()
            packed = [np.diff(place[a:b], prepend=0).astype("<u4").tobytes() + n[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            none = pa.nulls(len(ids), pa.list_(pa.int64()))
            values = [pa.array(np.full(len(ids), chunk)), ids, *(pa.array(columns[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "groups")), pa.array(packed, pa.binary()), none, none]
            yield pa.record_batch(values, names)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, counts)]
        none = [pa.nulls(1, pa.int64()) for _ in range(5)]
        yield pa.record_batch([pa.array([chunk], pa.int64()), *none, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, context, held, size, number = None, TaskContext.get(), [], 0, 0
        for batch in batches:
            aligner = aligner or Aligner(byte_path, piece_path, links)
            ids, texts = batch.column(0), batch.column(1)
            for a, b, _, offsets in K.slices(texts, SLICE_BYTES):
                held.append((ids.slice(a, b - a), *aligner.rows(texts.slice(a, b - a).to_pylist())))
                size += int(offsets[-1] - offsets[0])
                if size >= CHUNK_BYTES:
                    yield from flush(context.partitionId() << 32 | number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield from flush(context.partitionId() << 32 | number, held)

    return run


def counted(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The rows of a chunk's texts, from the corpus-wide counts of its pairs."""
    places = pairs.column("place").to_numpy() if pairs.num_rows else np.zeros(0, np.int64)
    count, best = np.zeros(int(places.max(initial=-1)) + 1, np.int64), np.zeros(int(places.max(initial=-1)) + 1, np.int64)
    if pairs.num_rows:
        count[places], best[places] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, sums = [], []
    for packed in texts.column("links").to_pylist():
        values = np.frombuffer(packed, "<u4").astype(np.int64)
        place, n = np.cumsum(values[: len(values) // 2]), values[len(values) // 2 :]
        n_best.append(int((best[place] * n).sum()))
        sums.append(int((count[place] * n).sum()))
    columns = {c: texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(columns | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups": texts.column("groups")})


def aligned(docs: DataFrame, byte_path: str, piece_path: str, links: str = "end") -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row of ``docs`` (doc_id,
    text), and (a, b, n, best), how often ids are linked.

    A is a byte-level BPE of space and text, B a sentencepiece model, both without special tokens; a special token's name
    inside a text is plain text. Ends that both have cut the tokens into groups; ``groups`` is the SHA-256 of
    ``a1,a2|b1;a3|b2,b3``. Linked are tokens with one end, or, with links="overlap", all that share a byte. ``best``: no A id
    is linked with this B id oftener, ties included; ``n_best`` and ``count_sum`` are over a text's links.

    A null or empty text, and one of which either tokenizer's bytes are not space and text, has no tokens: zeros and an
    empty string. Rows that repeat count each, a null doc_id stays, an empty table gives none; other columns are not looked
    at. Texts are encoded whole: a slice of SLICE_BYTES, or one longer text, is in memory at a time.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(texts.mapInArrow(encode(byte_path, piece_path, links), ENCODED))
    chunks = rows.where("pairs is not null")
    totals = chunks.select(F.inline(F.arrays_zip("pairs", "counts"))).groupBy("pairs").agg(F.sum("counts").alias("n"))
    totals = stored(totals.select(F.shiftright("pairs", 32).alias("a"), F.col("pairs").bitwiseAND(2**32 - 1).alias("b"), "n", "pairs"))
    most = totals.groupBy("b").agg(F.max("n").alias("most"))
    known = stored(totals.join(small_side(most), "b").select("pairs", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")))
    own = chunks.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pairs")).join(small_side(known.select("pairs", "n", "best")), "pairs")
    own = own.select("of", "place", "n", F.col("best").cast("long").alias("best"))
    each = rows.where("pairs is null").drop("pairs", "counts").groupBy("chunk").cogroup(own.groupBy("of"))
    return each.applyInArrow(counted, ALIGNED), known.select("a", "b", "n", "best")
