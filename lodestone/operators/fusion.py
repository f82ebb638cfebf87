"""Rank fusion, neighbours of hits, and first-seen duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60


def rrf(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, doc_id, rrf_score, dense_rank, dense_score, bm25_rank, rank: the sum of
    1 / (k + rank) over both lists; ties: the dense list's order first, then the sparse one's."""
    left = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    right = sparse.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"))

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0).cast("double") / (k + F.col(rank)), F.lit(0.0))

    both = left.join(right, ["query_id", "doc_id"], "full_outer").withColumn("rrf_score", part("dense_rank") + part("bm25_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    return both.withColumn("rank", F.row_number().over(order))


def hybrid_search(
    dense: Callable[[int], DataFrame], sparse: Callable[[int], DataFrame], top_k: int = 5, multiplier: int = 2, k: int = RRF_K
) -> DataFrame:
    """Both sides are asked for `multiplier` times as many, fused, and cut."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    fetch = top_k * multiplier
    return rrf(dense(fetch), sparse(fetch), k).filter(F.col("rank") <= top_k)


def linked_neighbours(chunks: DataFrame, window: int = 1, group: tuple[str, ...] = ("filepath", "function_name"), order: tuple[str, ...] = ("start_line", "end_line"), key: str = "id") -> DataFrame:
    """Each chunk's key and `linked`: the keys of its neighbours among the chunks of its symbol, in order, without itself."""
    if window < 0:
        raise ValueError("window must not be negative")
    around = Window.partitionBy(*group).orderBy(*order, key).rowsBetween(-window, window)
    near = chunks.withColumn("linked", F.collect_list(F.col(key)).over(around))
    return near.withColumn("linked", F.filter("linked", lambda x: x != F.col(key)))


def attach_linked(hits: DataFrame, chunks: DataFrame, window: int = 1, key: str = "id") -> DataFrame:
    """Hits (by doc_id) with their linked neighbours."""
    near = linked_neighbours(chunks, window, key=key).select(F.col(key).alias("doc_id"), "linked")
    return hits.join(near, "doc_id", "left")


def first_seen(rows: DataFrame, key: Column, order: list[Column], group: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key within a group, by the order."""
    place = F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def flatten_hits(hits: DataFrame) -> DataFrame:
    """query_id, position, doc_id, is_primary: hits in the order of rank, each followed by its linked chunks, first seen only."""
    payload = hits.select("query_id", "rank", F.posexplode(F.concat(F.array("doc_id"), F.coalesce("linked", F.array().cast(hits.schema["linked"].dataType)))).alias("payload", "doc_id"))
    once = first_seen(payload, F.col("doc_id"), [F.asc("rank"), F.asc("payload")], ("query_id",))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "payload"))
    return once.select("query_id", position.alias("position"), "doc_id", (F.col("payload") == 0).alias("is_primary"))
