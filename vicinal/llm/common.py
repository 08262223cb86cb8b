"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import staged

#: Words are runs of anything but the space and the control characters 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Most rows of a side that is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``by``; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


#: ``df`` written as a table of the shared folder and read again: its lineage ends there.
stored = staged


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of a few numbers; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label): one row per labelled doc_id; of contradicting labels the larger counts."""
    known = labels.select("doc_id", F.col(name).cast("int").alias("label"))
    return known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def hashed_sample(rows: DataFrame, limit: int, salt: int = 7) -> DataFrame:
    """The ``limit`` rows whose doc_id has the smallest hashes: the same rows in every run."""
    return rows.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(limit)


def size_of(text: Column) -> Column:
    """Number of words of a text, null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
