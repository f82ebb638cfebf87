"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import near_dedup, packing, passages, quality
from lodestone.llm.common import scratch


# What holds for all stages but the last: rows keep all their columns, also those of other names than a
# stage knows; n_chars follows a changed text.  Null texts count as empty; texts of any length are read
# whole; an empty table gives an empty one with the same columns.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, empty ones among them; the others lose their host's boilerplate
    lines.  Null hosts are one host.  Repeated rows get the same verdict and stay; there are no ties."""
    return quality.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest key, then hash of the text.  Repeated rows
    are copies; rows that share a key are told apart by their texts; rows without key stay."""
    return near_dedup.keep(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay in one of them, that with the smallest hash of key and text;
    identical rows are one document.  Documents of which no word is left go."""
    return passages.cut(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in training sequences, by their token ids.  Empty texts have their end token;
    repeated and null keys are packed row by row; pieces of one size go by key."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express chaining and packing; tests/llm/test_pipeline.py holds the stages and run() against a plain
#: version on a small fixture (test_run_against_a_plain_version).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each over what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
