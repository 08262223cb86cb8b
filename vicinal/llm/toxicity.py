"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models, one of toxic and one of ordinary labelled texts, are counted over all labelled documents. With the word v
before it a word w has

    P_c(w | v) = (n_c(v w) - min(n_c(v w), D)) / c_c(v) + (m_c(v) / c_c(v)) * P_c(w),
    P_c(w) = (n_c(w) - min(n_c(w), D)) / N_c + (M_c / N_c) * shared(w),

where m and M are what the discount D takes away, and shared(w) is in proportion to the number of different words that
stand before w in either class (its continuation count). What a class has seen no more than D times is left to the
shared counts whole and so tells nothing; a class that has not seen v falls back to P_c(w). The beginning of a text
counts as a word before.

A text is compared by its length-normalised log-likelihoods, of words alone and of words after words: their difference
over all words, and the part of it that lies beyond EVIDENCE in single words, so that a few toxic ones are not outweighed
by what a long text says otherwise. All four are for each word. A logistic curve, fitted on labelled texts that are not
counted, makes a score.

Counts are exact sums in tables that are dealt out by hash, grow with the corpus and never pass the driver. Texts lie in
chunks of about CHUNK_BYTES, as numbers of their words, in one exchange that all passes read:

1. A chunk sends each of its different pairs once, with the counts from its labelled texts, to the pair's bucket. The
   bucket sums them up, answers with the totals, and tells the first of the chunks that have the pair that it is the owner.
2. A chunk sums the totals of the pairs that it owns by first and second word, and sends each of its different words
   once to the word's bucket, which adds up and answers.
3. With both answers a chunk has all that its texts need.

Words are known by 48 bits of a hash; inside a bucket of BUCKET_BYTES of text, pairs and words by 32 more bits: a pair
that no labelled text has is taken for one that some have with a chance of about 2 in 10,000, whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .boosting import logistic
from .common import hashed_sample, labels_of, remainder, stored

CHUNK_BYTES = 24_000_000
#: Bytes of text for a bucket of pairs or words.
BUCKET_BYTES = 32_000_000
#: What is taken from each count and given to the shared counts.
DISCOUNT = 2
#: Nats beyond which a log-likelihood ratio is evidence.
EVIDENCE = 1.0
#: One of so many labelled documents is kept for the score's curve, and so many at most are used.
CURVE_SHARE = 6
CURVE_SAMPLE = 12_000
THRESHOLD = 0.3
#: Numbers that are known of a text.
WIDTH = 4

#: Words for this purpose: letters and digits, and all beyond ASCII.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False

#: What stands before the first word of a text, among words of 48 bits.
START = K.U64(0x5AFE0F57A270)

CHUNK = "chunk long, doc_ids array<long>, body binary"
MESSAGE = "bucket long, chunk long, kind int, packed binary"
PAIRS, WORDS = 0, 1


# Columns of numbers as bytes.


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, plane by plane (the lowest bytes of all numbers first), compressed."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], n * sum(k.itemsize for k in kinds), codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for k in kinds:
        to = at + n * k.itemsize
        out.append(np.ascontiguousarray(raw[at:to].reshape(k.itemsize, n).T).view(k).ravel())
        at = to
    return out


def steps(ranked: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, the first from 0; their sums are the numbers again."""
    return np.diff(ranked, prepend=ranked.dtype.type(0))


# Chunks.


def gathered(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of about ``most`` bytes of text, over the ends of batches."""
    held, size = [], 0
    for batch in batches:
        column, at = batch.column(1), 0
        for a, b, _, offsets in K.slices(column, most):
            if held and size + int(offsets[-1] - offsets[0]) > most:
                yield tuple(pa.concat_arrays(x) for x in zip(*held, strict=True))
                held, size = [], 0
            held.append((batch.column(0).slice(a, b - a), column.slice(a, b - a)))
            size += int(offsets[-1] - offsets[0])
    if held:
        yield tuple(pa.concat_arrays(x) for x in zip(*held, strict=True))


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text) to chunks. Their numbers are the task's and theirs in it, so a task run again repeats them."""
    task = TaskContext.get().partitionId()
    for number, (ids, texts) in enumerate(gathered(batches)):
        _, _, data, offsets = next(K.slices(texts, 1 << 62))
        words = K.split(data, offsets, BETWEEN)
        known, at, n = np.unique(words.hashes(lower=True) >> K.U64(16), return_inverse=True, return_counts=True)
        place = np.empty(len(known), "<u4")  # frequent words have small numbers, which take little room
        place[np.argsort(-n, kind="stable")] = np.arange(len(known))
        parts = [packed(words.counts().astype("<u4")), packed(steps(known), n.astype("<u4")), packed(place[at])]
        body = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
        rows = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), rows, pa.array([body], pa.binary())], ["chunk", "doc_ids", "body"])


class Chunk:
    """A chunk's texts: counts of words by text, the different words, and the number of each word and pair in turn.

    Pairs are numbered in the order of their buckets and keys, words by their hash; the word after the last is START.
    """

    def __init__(self, table: pa.Table, buckets: int):
        if table.num_rows != 1:
            raise ValueError(f"{table.num_rows} chunks of one number")
        self.number = table.column("chunk")[0].as_py()
        self.doc_ids = table.column("doc_ids").combine_chunks().flatten()
        body, parts = table.column("body")[0].as_py(), []
        while body:
            n = int.from_bytes(body[:8], "little")
            parts.append(body[8 : 8 + n])
            body = body[8 + n :]
        (counts,) = unpacked(parts[0], "<u4")
        known, n = unpacked(parts[1], "<u8", "<u4")
        (place,) = unpacked(parts[2], "<u4")
        self.counts = counts.astype(np.int64)
        self.words = np.append(np.cumsum(known, dtype=K.U64), START)
        self.at = np.argsort(-n.astype(np.int64), kind="stable")[place]
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.buckets = buckets
        size = len(self.words)
        before = np.concatenate(([size - 1], self.at[:-1]))[: len(self.at)]
        before[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = size - 1
        codes, which = np.unique(before * size + self.at, return_inverse=True)
        before, word = codes // size, codes % size
        order, self.bucket, self.key = self.dealt(K.mixed(self.words[before] * K.STEP + self.words[word]))
        self.before, self.word = before[order], word[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.which = back[which]

    def dealt(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, bucket, key): order sorts hashes by bucket and key; bucket and key are in that order."""
        bucket, key = (hashes >> K.U64(40)) % K.U64(self.buckets), hashes & K.U64(0xFFFFFFFF)
        order = np.argsort(bucket << K.U64(32) | key, kind="stable")
        return order, bucket[order], key[order].astype("<u4")

    def messages(self, kind: int, bucket: np.ndarray, key: np.ndarray, numbers: list[np.ndarray]) -> pa.Table:
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
        ends = np.append(cuts, len(bucket))[1:]
        data = [packed(steps(key[a:b]), *(n[a:b].astype("<i8") for n in numbers)) for a, b in zip(cuts, ends, strict=True)]
        return sent(bucket[cuts].astype(np.int64), np.full(len(cuts), self.number), kind, data)

    def answers(self, found: pa.Table, kind: int, buckets: np.ndarray, width: int) -> list[np.ndarray]:
        """The numbers that answer what the chunk has sent, in the order of sending."""
        mine = {b: p for b, k, p in zip(*(found.column(c).to_pylist() for c in ("bucket", "kind", "packed")), strict=True) if k == kind}
        names, sizes = np.unique(buckets, return_counts=True)
        out = [np.zeros((width, 0), np.int64)]
        for b, n in zip(names.tolist(), sizes.tolist(), strict=True):
            part = np.stack(unpacked(mine[b], *["<i8"] * width)) if b in mine else np.zeros((width, n), np.int64)
            if part.shape[1] != n:
                raise ValueError(f"{part.shape[1]} answers to {n} questions")
            out.append(part)
        return list(np.concatenate(out, axis=1))


def sent(buckets, chunks, kind: int, data: list[bytes]) -> pa.Table:
    n = len(data)
    return pa.table([pa.array(buckets, pa.int64()), pa.array(chunks, pa.int64()), pa.array(np.full(n, kind, np.int32)), pa.array(data, pa.binary())], names=["bucket", "chunk", "kind", "packed"])


def summed(table: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray, list[int], list[int]]:
    """(sums, group, first, sizes) of the messages of a bucket: sums by different key; for each entry its key's number."""
    parts = [unpacked(p, "<u4", *["<i8"] * width) for p in table.column("packed").to_pylist()]
    keys = np.concatenate([np.cumsum(p[0], dtype="<u4") for p in parts])
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    sums = []
    for k in range(width):
        numbers = np.concatenate([p[1 + k] for p in parts])
        some = np.flatnonzero(numbers)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, group[some], numbers[some])
        sums.append(total)
    return sums, group, first, [len(p[0]) for p in parts]


def answered(table: pa.Table, kind: int, columns: list[np.ndarray], sizes: list[int]) -> pa.Table:
    """An answer to each message; of pairs only where there is something to be told."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    rows = [(c, packed(*(x[a:b].astype("<i8") for x in columns))) for c, a, b in zip(chunks, bounds[:-1], bounds[1:], strict=True) if kind == WORDS or any(x[a:b].any() for x in columns)]
    return sent([bucket] * len(rows), [c for c, _ in rows], kind, [p for _, p in rows])


# The passes.


def listed(table: pa.Table) -> pa.Table:
    """(doc_id, chunk, place) of a chunk's texts."""
    ids = table.column("doc_ids").combine_chunks().flatten()
    n = len(ids)
    return pa.table([ids, pa.array(np.full(n, table.column("chunk")[0].as_py())), pa.array(np.arange(n))], names=["doc_id", "chunk", "place"])


def ask_pairs(buckets: int):
    """A chunk's pairs with their counts in its labelled texts; known: (place, label)."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([], [], PAIRS, [])
        chunk = Chunk(table, buckets)
        label = np.full(len(chunk.counts), -1)
        label[known.column("place").to_numpy()] = known.column("label").to_numpy()
        label = label[chunk.text]
        n = [np.bincount(chunk.which[label == c], minlength=len(chunk.word)) for c in (0, 1)]
        return chunk.messages(PAIRS, chunk.bucket, chunk.key, n)

    return run


def tell_pairs(table: pa.Table) -> pa.Table:
    """For each pair of a message n0 and n1, its counts by class, and whether the chunk is its owner."""
    table = table.sort_by("chunk")  # the owner is the same, whichever message comes first
    (n0, n1), group, first, sizes = summed(table, 2)
    own = np.zeros(len(group), np.int64)
    own[first[(n0 > 0) | (n1 > 0)]] = 1
    return answered(table, PAIRS, [n0[group], n1[group], own], sizes)


def ask_words(buckets: int):
    """A chunk's words, with what the pairs that it owns say: before, n0, n1 of second words, c0, c1, m0, m1 of first ones."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([], [], WORDS, [])
        chunk = Chunk(table, buckets)
        n0, n1, own = chunk.answers(found, PAIRS, chunk.bucket, 3)
        mine = np.flatnonzero(own)
        by = lambda side, x: np.bincount(side[mine], x[mine], len(chunk.words)).astype(np.int64)
        less = [np.minimum(n, DISCOUNT) for n in (n0, n1)]
        numbers = [by(chunk.word, own), by(chunk.word, n0), by(chunk.word, n1), by(chunk.before, n0), by(chunk.before, n1), by(chunk.before, less[0]), by(chunk.before, less[1])]
        order, bucket, key = chunk.dealt(K.mixed(chunk.words))
        return chunk.messages(WORDS, bucket, key, [x[order] for x in numbers])

    return run


def tell_words(table: pa.Table) -> pa.Table:
    sums, group, _, sizes = summed(table, 7)
    return answered(table, WORDS, [s[group] for s in sums], sizes)


def total_words(table: pa.Table) -> pa.Table:
    """One row of a bucket: (before, rows, n0, n1, m0, m1) over its words that stand in a labelled text."""
    (before, n0, n1, *_), *_ = summed(table, 7)
    sums = [WORDS, before.sum(), (before > 0).sum(), n0.sum(), n1.sum(), np.minimum(n0, DISCOUNT).sum(), np.minimum(n1, DISCOUNT).sum()]
    return pa.table([pa.array([int(x)], pa.int64()) for x in sums], names=["kind", *TOTALS])


TOTALS = ("before", "rows", "n0", "n1", "m0", "m1")


def ratios(words: list[np.ndarray], pairs: list[np.ndarray], first: np.ndarray, second: np.ndarray, totals: dict) -> tuple[np.ndarray, np.ndarray]:
    """log P_toxic - log P_ordinary of words, and of the second words of pairs.

    words: before, n0, n1, c0, c1, m0, m1 of each word; pairs: n0, n1 of each pair (first, second).
    """
    before = words[0]
    shared = (before + 0.5) / (totals["before"] + 0.5 * (totals["rows"] + 1))
    alone, after = [], []
    for c in (0, 1):
        n, follow, less = words[1 + c], words[3 + c], words[5 + c]
        every = max(1, totals[f"n{c}"])
        p = (n - np.minimum(n, DISCOUNT)) / every + (totals[f"m{c}"] / every if totals[f"n{c}"] else 1.0) * shared
        seen = np.maximum(follow, 1)
        left = np.where(follow > 0, less / seen, 1.0)
        own = (pairs[c] - np.minimum(pairs[c], DISCOUNT)) / seen[first]
        alone.append(np.log(p))
        after.append(np.log(own + left[first] * p[second]))
    return alone[1] - alone[0], after[1] - after[0]


def features(text: np.ndarray, counts: np.ndarray, each: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per text, of words alone and then of words after words: the difference of the mean log-likelihoods, and the part of
    it that lies beyond EVIDENCE in single words."""
    n = np.maximum(counts, 1).astype(float)
    per = lambda x: np.bincount(text, x, len(counts))
    out = []
    for ratio in each:
        strong = per(np.maximum(ratio - EVIDENCE, 0))
        out += [per(ratio) / n, strong / n]
    return np.stack(out, axis=1)


def measure(buckets: int):
    """From a chunk and all answers to (doc_id, x) of its texts."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64()))})
        chunk = Chunk(table, buckets)
        totals = {k: pc.max(found.column(k)).as_py() or 0 for k in TOTALS}
        n0, n1, _ = chunk.answers(found, PAIRS, chunk.bucket, 3)
        order, bucket, _ = chunk.dealt(K.mixed(chunk.words))
        words = []
        for x in chunk.answers(found, WORDS, bucket, 7):
            back = np.empty(len(order), np.int64)
            back[order] = x
            words.append(back)
        alone, after = ratios(words, [n0, n1], chunk.before, chunk.word, totals)
        x = features(chunk.text, chunk.counts, (alone[chunk.at], after[chunk.which]))
        return pa.table({"doc_id": chunk.doc_ids, "x": pa.array(list(x), pa.list_(pa.float64()))})

    return run


def measured(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, x) of each row of ``texts`` (doc_id, text), as a table in the shared folder; known: (doc_id, label)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, buckets = max(least, -(-size // CHUNK_BYTES)), max(least, -(-size // BUCKET_BYTES))
    by_chunk, by_bucket = lambda df: df.repartition(parts, "chunk"), lambda df: df.repartition(buckets, "bucket")
    chunks = by_chunk(texts.mapInArrow(chunked, CHUNK)).groupBy("chunk")
    labelled = by_chunk(chunks.applyInArrow(listed, "doc_id long, chunk long, place long").join(known, "doc_id").select("chunk", "place", "label"))
    pairs = by_bucket(chunks.cogroup(labelled.groupBy("chunk")).applyInArrow(ask_pairs(buckets), MESSAGE)).groupBy("bucket")
    told = by_chunk(pairs.applyInArrow(tell_pairs, MESSAGE))
    words = by_bucket(chunks.cogroup(told.groupBy("chunk")).applyInArrow(ask_words(buckets), MESSAGE)).groupBy("bucket")
    # One row, for the answers about words.
    totals = words.applyInArrow(total_words, ", ".join(f"{k} long" for k in ("kind", *TOTALS))).groupBy("kind").agg(*(F.sum(k).alias(k) for k in TOTALS))
    answers = told.unionByName(by_chunk(words.applyInArrow(tell_words, MESSAGE))).join(F.broadcast(totals), "kind", "left")
    return stored(chunks.cogroup(answers.groupBy("chunk")).applyInArrow(measure(buckets), "doc_id long, x array<double>"))


def score_toxicity(docs: DataFrame, labels: DataFrame, by: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text); labels: (doc_id, toxic).

    Labels of held-out rows (crc32 of the doc_id modulo ``by`` is ``held_out``) are not looked at. A text without words
    has the score of no evidence at all. Repeated rows have equal scores (and those with labels are counted each); a row
    without doc_id is scored and not held out, and a very long text is scored whole. Labels that are neither 0 nor 1 count for nothing, and of contradicting
    ones the larger counts. Without labels all scores are 0.5. An empty table gives no rows; other columns are not
    looked at.
    """
    out = F.coalesce(remainder(F.col("doc_id"), by) == held_out, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = labels_of(labels, "toxic").where(~out)
    kept = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(CURVE_SHARE)) == 0
    x = measured(texts, known.where(~kept))

    curve = hashed_sample(known.where(kept).join(x.select("doc_id").distinct(), "doc_id", "left_semi"), CURVE_SAMPLE)
    found = x.join(F.broadcast(curve), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r"))
    found = sorted(found.select("doc_id", "r.label", "r.x").collect())
    weights = logistic(np.array([r.x for r in found], float).reshape(len(found), WIDTH), np.array([r.label for r in found], float))
    z = sum((F.get("x", F.lit(k)) * float(w) for k, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    scored = x.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
