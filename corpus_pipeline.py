"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vicinal.llm.common import stored, table
from vicinal.llm.mixing import mixture
from vicinal.llm.neardup import drop_near_duplicates
from vicinal.llm.packing import pack
from vicinal.llm.queries import tokenizer_path
from vicinal.llm.rules import drop_rejected
from vicinal.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns; null and empty texts go, repeated rows go or stay alike.

    Very long texts are judged whole. Without labels, or in an empty table, only the base rules judge.
    """
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group that shares four fifths of its five-word shingles.

    Texts without words and rows without doc_id stay; of several rows of one doc_id one stays. Texts are taken whole, an
    empty table stays one, and other columns are kept.
    """
    return drop_near_duplicates(docs, words=5, bound=(4, 5))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret. Nulls and other columns stay, texts are taken whole, repeated
    rows are changed alike, and an empty table stays one."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, the last one of a source cut to the words that are left.

    Texts without words go, a null source is one of its own, repeated rows count each, an empty table stays one.
    """
    return mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its sequence and its place there.

    A null or empty text is its end mark alone, a very long one goes over as many sequences as it needs, repeated rows
    are packed each, an empty table gives no rows.
    """
    return pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Learned rules and a tokenizer are not to be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
