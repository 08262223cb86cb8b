"""The queries of this subpackage: thin calls of its operators over whole tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chat import ROTATE_SQL
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import listed, rotate

    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", listed(F.col("mask")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE_KINDS, find_secrets, listed

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = {f"n_{k}": F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as bigint)") for k in BASE_KINDS}
    base = listed(F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS)))
    return found.select("doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judged, learn_rules

    docs = table(spark, sf_dir, "documents")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 100 = 0"), vectors, k=10)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, bound=(85, 100))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import aligned

    texts, _ = aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return texts.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_chat": op3_chat,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_rules": op7_rules,
    "op8_nearest": op8_nearest,
    "op9_neardup": op9_neardup,
    "op10_substrings": op10_substrings,
    "op11_phrases": op11_phrases,
    "op12_contamination": op12_contamination,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat": ROTATE_SQL,
    "op5_mixing": oracles.MIXING,
    "op8_nearest": oracles.NEAREST,
    "op9_neardup": oracles.NEARDUP,
    "op10_substrings": oracles.SUBSTRINGS,
    "op11_phrases": oracles.PHRASES,
    "op12_contamination": oracles.CONTAMINATION,
}
