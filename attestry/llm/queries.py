"""Queries opN_<name> over the driver's tables, each through its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm._text import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents")).drop("sid")


def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"), links=True).drop("sid")


def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.fingerprint import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.revisit import capture_log, digest, resolve

    return digest(resolve(capture_log(read(spark, sf_dir, "pages"))))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.lm_score import lm_scores

    return lm_scores(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.language import language_id

    return language_id(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.language import held_out
    from attestry.llm.toxicity import toxicity

    scored = toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.pack import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.token_count import token_counts

    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).drop("text")


def op9_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.chat import digest, prefix_tree

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(prefix_tree(given, tokenizer_path()), tokenizer_path())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.decontaminate import contamination, digest

    return digest(contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op1_jaccard_links": op1_jaccard_links,
    "op2_weighted_fingerprints": op2_weighted_fingerprints,
    "op3_revisit_resolution": op3_revisit_resolution,
    "op4_lm_scores": op4_lm_scores,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_curve_packing": op7_curve_packing,
    "op8_token_counts": op8_token_counts,
    "op9_chat_prefix_tree": op9_chat_prefix_tree,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
