"""A quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed from the bytes of whole texts, batch by batch. The trees are fitted on the driver to the
statistics of at most ``sample`` labelled rows, a number that doesn't grow with the corpus, and go to the workers as
flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .boosting import Trees, fit
from .common import hashed_sample, labels_of, remainder

#: Labelled rows that the trees are fitted on, at most: those whose doc_id has the smallest hashes.
SAMPLE = 12_000
THRESHOLD = 0.3

NAMES = (
    "log_words", "word_length", "longest_word", "symbol_share", "mark_share", "upper_share", "digit_share", "end_share",
    "other_share", "words_per_line", "repeated_line_share", "adjacent_share", "distinct_share", "repeated_3_share", "short_share", "top_share",
)


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


CLASSES = (_table("#*$%&|<>"), _table("!?;:=_~^"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(".,"))
OTHER = np.arange(256) >= 128
NEWLINE = _table("\n")


def _runs(h: np.ndarray) -> np.ndarray:
    """How often each different hash occurs."""
    s = np.sort(h)
    return np.diff(np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text ``data[offsets[k]:offsets[k + 1]]``; an empty text has zeros."""
    words = K.split(data, offsets)
    hashes = words.hashes()
    lines = K.split(data, offsets, NEWLINE)
    line_hashes = lines.hashes()
    text, edges = words.data, offsets - offsets[0]
    lengths = words.ends - words.starts
    n, chars = words.counts().astype(float), np.add.reduceat(np.append(lengths, 0), words.bounds[:-1]) * (words.counts() > 0)
    out = np.zeros((len(n), len(NAMES)))
    some, many = np.maximum(n, 1), np.maximum(chars, 1)
    share = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[text])))[edges]) / many
    out[:, 0], out[:, 1] = np.log1p(n), chars / some
    for k, table in enumerate(CLASSES):
        out[:, 3 + k] = share(table)
    out[:, 8] = share(OTHER)
    out[:, 9] = n / np.maximum(lines.counts(), 1)
    same = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    same[words.bounds[:-1][words.counts() > 0]] = False
    sums = np.concatenate(([0], np.cumsum(same)))
    out[:, 11] = (sums[words.bounds[1:]] - sums[words.bounds[:-1]]) / some
    short = np.concatenate(([0], np.cumsum(lengths <= 3)))
    out[:, 14] = (short[words.bounds[1:]] - short[words.bounds[:-1]]) / some
    triples = K.windows(hashes, 3)
    for k in np.flatnonzero(n > 0).tolist():
        a, b = int(words.bounds[k]), int(words.bounds[k + 1])
        runs = _runs(hashes[a:b])
        out[k, 2] = lengths[a:b].max()
        out[k, 12], out[k, 15] = len(runs) / (b - a), runs.max() / (b - a)
        if b - a >= 4:
            found = _runs(triples[a : b - 2])
            out[k, 13] = found[found > 1].sum() / (b - a - 2)
        c, d = int(lines.bounds[k]), int(lines.bounds[k + 1])
        if d - c > 1:
            out[k, 10] = 1 - len(_runs(line_hashes[c:d])) / (d - c)
    return out


def per_text(column: pa.Array, function) -> np.ndarray:
    """function(bytes, offsets) over the texts of a column, put together."""
    parts = [function(data, offsets) for _, _, data, offsets in K.slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = per_text(batch.column(2), statistics)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for the labels (doc_id, label) of at most ``sample`` of the documents. Rows of one doc_id count once."""
    known = hashed_sample(labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    found = rows.select("doc_id", "label", "text").mapInArrow(measured, "doc_id long, label int, x array<double>")
    found = sorted(found.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.label", "r.x").collect())
    x = np.array([r.x for r in found], float).reshape(len(found), len(NAMES))
    return fit(x, np.array([r.label for r in found], float))


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = trees.scores(per_text(batch.column(1), statistics))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, by: int = 5, held_out: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text); labels: (doc_id, quality).

    Labels of held-out rows (crc32 of the doc_id modulo ``by`` is ``held_out``) are not looked at. Null and empty texts
    are scored by statistics that are all zero, very long ones whole. Repeated rows have equal scores; a row without doc_id is scored and not
    held out. Labels that are neither 0 nor 1 count for nothing, and of contradicting ones the larger counts. Without
    labels all scores are 0.5. An empty table gives no rows; other columns are not looked at.
    """
    out = F.coalesce(remainder(F.col("doc_id"), by) == held_out, F.lit(False))
    trees = fitted(docs, labels_of(labels, "quality").where(~out), sample)
    return scored(docs, trees).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
