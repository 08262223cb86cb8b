"""Mixing sources to target weights.

A document's key is the SHA-256 of its id and text, so a source's order is random but fixed, also among rows of one id
or of none. Within each source the documents are ranged by the first digits of the key (as many as leave about
SLICE_ROWS rows of the table to a range, each a unit of shuffling, so that a hot source is spread), ordered inside their
range, and their word counts summed up: totals of ranges first, then a running sum over the ranges
of a source and one inside each range. A source takes its documents whole as often as its budget allows, and once more
up to the word at which the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import size_of, words_of

#: Rows of the whole table for a range of keys.
SLICE_ROWS = 2_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with each source's target.

    Sources by code point, null last, have the weights in turn and share ``share`` of all words; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight: min(cap, weight * level) adds up to
    the goal. Taking the sources before each rank (by cap per weight) as full gives a level that is never too high, and
    at one rank the right one, so the largest is right. One row per source passes through one task, which is meant for
    as many sources as a window sorts in a task (millions), not for a source per document.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    everything = W.partitionBy()
    cap = F.lit(float(most)) * F.col("source_size")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_fill = W.orderBy("fill", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("fill", cap / F.col("weight"))
        .withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("goal") - F.coalesce(F.sum(cap).over(by_fill), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0))))
    )
    level = F.max("level").over(everything)
    return levels.withColumn("target", F.least(cap, F.col("weight") * level)).select("source", "source_size", "weight", "target")


def _placed(docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """_id, _source, _size, _source_size, _target, _epochs and _part (words of the last, cut epoch), and ``docs`` as _row."""
    digits = max(1, math.ceil(math.log(max(1, docs.count() / SLICE_ROWS), 16)))
    key = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))).cast("binary"), 256)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    source = F.col("source").cast("string")
    # A source is a text and whether there is none, so that windows and joins have plain keys and share their exchange.
    own = F.coalesce(source, F.lit("")).alias("_source"), source.isNull().alias("_none")
    rows = docs.select(F.col("doc_id").alias("_id"), *own, size_of(F.col("text")).alias("_size"), key.alias("_key"), row.alias("_row"))
    rows = rows.withColumn("_slice", F.substring("_key", 1, digits))
    slices = rows.groupBy("_source", "_none", "_slice").agg(F.sum("_size").alias("slice_size"))
    before = W.partitionBy("_source", "_none").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = slices.groupBy("_source", "_none").agg(F.sum("slice_size").alias("source_size")).withColumn("source", F.when(~F.col("_none"), F.col("_source")))
    goals = targets(sizes.select("source", "source_size"), weights, share, most)
    goals = goals.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    offsets = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    per_slice = offsets.join(goals, ["_source", "_none"]).drop("slice_size")
    inside = W.partitionBy("_source", "_none", "_slice").orderBy("_key", "_id").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    joined = placed.join(per_slice, ["_source", "_none", "_slice"])
    budget = F.round("_target").cast("long")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.col("_source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("_source_size")
    part = F.least(F.col("_size"), F.greatest(F.lit(0), rest - F.col("before") - F.col("inside")))
    return joined.select("_id", F.when(~F.col("_none"), F.col("_source")).alias("_source"), "_size", "_source_size", "_target", epochs.cast("long").alias("_epochs"), part.cast("long").alias("_part"), "_row")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each row of ``docs``.

    A null text has no words; a null source is a source of its own. Rows of one doc_id, or of none, are ordered like
    others, by id and text; equal ones follow each other. A text may be as long as a row. An empty table gives no rows. Other columns are not looked at.
    """
    rows = _placed(docs.select("doc_id", "source", "text"), weights, share, most)
    taken = (F.col("_epochs") * F.col("_size") + F.col("_part")).cast("long")
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken")
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and others) as often as the mix takes them, with the same columns.

    The row at which a source's budget ends comes cut to the words that are left of it, joined by one space; of rows with
    one id and text it may be any. Rows of which no word is taken, and those without words, are left out; very long texts are
    counted and cut whole. Nulls, an empty
    table and clashing columns as for ``mix``; a column of this module's own names (with a leading underscore) is kept.
    """
    rows = _placed(docs, weights, share, most)
    whole = F.when(F.col("_part") == F.col("_size"), F.lit(1)).otherwise(F.lit(0))
    copies = F.when(F.col("_size") > 0, F.col("_epochs") + whole).otherwise(F.lit(0)).cast("int")
    cut = (F.col("_part") > 0) & (F.col("_part") < F.col("_size"))
    parts = F.concat(F.array_repeat(F.lit(False), copies), F.array_repeat(F.lit(True), F.when(cut, F.lit(1)).otherwise(F.lit(0))))
    each = rows.withColumn("_cut", F.explode(parts))
    text = F.when(F.col("_cut"), F.array_join(F.slice(words_of(F.col("_row.text")), F.lit(1), F.greatest(F.col("_part").cast("int"), F.lit(1))), " ")).otherwise(F.col("_row.text"))
    return each.select(*(text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))
