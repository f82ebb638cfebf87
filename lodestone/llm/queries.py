"""Queries of the operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, html, importance, licenses, lm, mixture, near_dedup, neighbours, packing, passages, quality, token_files, tokenize

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> tuple[str, str]:
    """Place of a public vocabulary file and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.digests(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.tiktoken"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.json"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents")).drop("did")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.classes(table(spark, sf_dir, "documents"), size=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")[0])[0]


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.pack_mixture(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")[0])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_license_scan": op2_license_scan,
    "op3_lm_scores": op3_lm_scores,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_main_text": op5_main_text,
    "op6_token_files": op6_token_files,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_mixture_packing": op12_mixture_packing,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.sql(),
    "op8_near_duplicates": near_dedup.SQL,
    "op9_quality_rules": quality.SQL,
    "op13_importance_resampling": importance.SQL,
}
