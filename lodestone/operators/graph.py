"""Approximate nearest neighbours by cosine: a navigable proximity graph for each shard of the vectors.

Vectors are dealt to shards of bounded size by a hash of their key.  In its shard a vector is linked with
near ones in different directions (a candidate is left out if it is nearer to one that is already
linked), with those that chose it, and with a few at random, which lead from region to region.
A query goes to every shard.  There it walks from the best point that it knows to that point's
neighbours, keeping the `beam` best, until none of them leads to a better one.  Queries are dealt in
blocks, so a task holds one shard and one block whatever their number.

Vectors that are null, empty, zero or hold null or infinite components take no part, nor do null keys.  Equal keys are
points of their own.  Results are the same however rows lie in files: rows are ordered by key and vector, random
links follow from the shard's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stored
from .dense import knn_topk

#: Rows of a shard, links of a point, candidates for them, random links, points that a walk keeps, queries of a block.
SHARD_ROWS, DEGREE, CANDIDATES, RANDOM, BEAM, BLOCK = 20_000, 24, 64, 4, 128, 2048
#: Queries that walk together.
TOGETHER = 128


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _units(table: pa.Table, name: str) -> np.ndarray:
    values = np.asarray(table[name].combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def nearest_in_shard(points: np.ndarray, count: int, block: int = 512) -> np.ndarray:
    """The `count` nearest others of each point, nearest first."""
    out = np.empty((len(points), count), np.int32)
    for a in range(0, len(points), block):
        scores = points[a : a + block] @ points.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        near = np.argpartition(-scores, count - 1, axis=1)[:, :count]
        out[a : a + block] = np.take_along_axis(near, np.argsort(-np.take_along_axis(scores, near, 1), axis=1, kind="stable"), 1)
    return out


def linked(points: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, random: int = RANDOM) -> np.ndarray:
    """Links of each point (-1: none): up to `degree` in different directions, then those that chose it, up to twice as many, then random ones."""
    n = len(points)
    count = min(candidates, n - 1)
    if count < 1:
        return np.full((n, 1), -1, np.int32)
    near = nearest_in_shard(points, count)
    own = np.full((n, degree), -1, np.int32)
    for a in range(0, n, 1024):
        rows = near[a : a + 1024]
        there = points[rows]
        apart = np.einsum("ncd,ned->nce", there, there)  # nearness of candidates to each other
        to = np.einsum("ncd,nd->nc", there, points[a : a + 1024])
        kept = np.zeros(rows.shape, bool)
        for c in range(count):
            covered = (kept & (apart[:, c] > to[:, c : c + 1])).any(axis=1)
            kept[:, c] = ~covered & (kept.sum(axis=1) < degree)
        rank = np.cumsum(kept, axis=1) - 1
        at, c = np.nonzero(kept)
        own[a + at, rank[at, c]] = rows[at, c]
    source, place = np.nonzero(own >= 0)
    target = own[source, place]
    order = np.lexsort((place, target))  # who chose a point, the closest choices first
    source, target = source[order], target[order]
    turn = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, degree), -1, np.int32)
    few = turn < degree
    back[target[few], turn[few]] = source[few]
    far = np.random.default_rng(n).integers(0, n, (n, random), dtype=np.int32)
    return np.concatenate([own, back, far], axis=1)


def walk(points: np.ndarray, links: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best points found for each query and their scores (-inf: none), and how many were compared."""
    n, m, beam = len(points), len(queries), max(beam, k)
    starts = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))  # any points will do
    seen = np.zeros((m, n), bool)
    seen[:, starts] = True
    ids = np.full((m, beam + len(starts)), -1, np.int64)
    ids[:, : len(starts)] = starts
    scores = np.full(ids.shape, -np.inf)
    scores[:, : len(starts)] = queries @ points[starts].T
    walked = np.ones(ids.shape, bool)
    walked[:, : len(starts)] = False
    compared = np.full(m, len(starts))

    def best(ids, scores, walked):
        order = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
        return (np.take_along_axis(x, order, 1) for x in (ids, scores, walked))

    ids, scores, walked = best(ids, scores, walked)
    active = np.arange(m)
    while len(active):
        open_ = ~walked[active]
        going = open_.any(axis=1)
        active, open_ = active[going], open_[going]
        if not len(active):
            break
        first = open_.argmax(axis=1)  # the best that was not walked from
        at = ids[active, first]
        walked[active, first] = True
        there = links[at].astype(np.int64)
        fresh = (there >= 0) & ~seen[active[:, None], there]
        fresh &= np.arange(there.shape[1]) == np.argmax(there[:, :, None] == there[:, None, :], axis=1)  # each once
        who, place = np.nonzero(fresh)
        if not len(who):
            continue
        point = there[who, place]
        seen[active[who], point] = True
        np.add.at(compared, active[who], 1)
        more = np.full(there.shape, -np.inf)
        more[who, place] = np.einsum("nd,nd->n", queries[active[who]], points[point])
        joined = best(
            np.concatenate([ids[active], there], axis=1),
            np.concatenate([scores[active], more], axis=1),
            np.concatenate([walked[active], ~fresh], axis=1),
        )
        ids[active], scores[active], walked[active] = joined
    order = np.lexsort((ids, -np.round(scores, 9)), axis=1)[:, :k]  # equal scores go by place, that is by key
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1), compared


def build_graph(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> DataFrame:
    """shard, place (in the shard), doc_id, v and links (places) of every vector: a table to keep and search."""
    rows = vectors.select(F.col(key).alias("doc_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("doc_id").isNotNull() & usable(F.col("v")))
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "v"), F.lit(shards)).cast("int"))
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("place", T.IntegerType()), *rows.schema.fields, T.StructField("links", T.ArrayType(T.IntegerType()))])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def build(table: pa.Table) -> pa.Table:
        keys, values = table["doc_id"].to_pylist(), table["v"].to_pylist()
        table = table.take(pa.array(sorted(range(len(keys)), key=lambda i: (keys[i], values[i]))))
        links = linked(_units(table, "v"), degree)
        columns = [table["shard"], pa.array(np.arange(table.num_rows, dtype=np.int32)), table["doc_id"], table["v"], pa.array(list(links))]
        return pa.table([c.cast(k) for c, k in zip(columns, kinds, strict=True)], schema.fieldNames())

    return dealt.groupBy("shard").applyInArrow(build, schema)


def graph_topk(graph: DataFrame, queries: DataFrame, k: int = 10, query_key: str = "query_id", vector: str = "embedding", beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, score, rank and compared (points compared in all shards) of the k nearest found; ties go to the smaller id."""
    asked = queries.select(F.col(query_key).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).filter(F.col("query_id").isNotNull() & usable(F.col("q")))
    out = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc_id", graph.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("compared", T.LongType())])
    if k <= 0:
        return graph.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(1))
    blocks = max(1, -(-asked.count() // block))
    shards = graph.agg(F.max("shard")).first()[0]
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = graph.select("shard", "place", "doc_id", "v", "links", every(blocks, "block"))
    right = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)).cast("int").alias("block"), every((shards or 0) + 1, "shard"))
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def search(points: pa.Table, questions: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if points.num_rows and questions.num_rows:
            points = points.sort_by("place")
            x, q = _units(points, "v"), _units(questions, "q")
            links = np.asarray(points["links"].combine_chunks().flatten()).reshape(points.num_rows, -1)
            keys, names = points["doc_id"].to_pylist(), questions["query_id"].to_pylist()
            for a in range(0, len(q), TOGETHER):
                ids, scores, compared = walk(x, links, q[a : a + TOGETHER], k, beam)
                for name, at, s, c in zip(names[a : a + TOGETHER], ids.tolist(), scores.tolist(), compared.tolist(), strict=True):
                    good = [i for i in range(len(at)) if s[i] > -np.inf]
                    for column, values in zip(columns, ([name] * len(good), [keys[at[i]] for i in good], [s[i] for i in good], [c] + [0] * (len(good) - 1)), strict=True):
                        column += values
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], out.fieldNames())

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, out)  # k rows for each query and shard
    own = Window.partitionBy("query_id")
    place = F.row_number().over(own.orderBy(F.desc(F.round("score", 9)), F.asc("doc_id")))
    return found.withColumns({"compared": F.sum("compared").over(own), "rank": place}).filter(F.col("rank") <= k)


def confirmed_topk(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, doc_id, score, rank: the exact k nearest after a walk.  What the walk found (`graph_topk`) gives a score that k points
    reach; all points are held against it, and only those that reach it too are ranked."""
    reached = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
    reached = stored(reached.select(F.col("query_id").alias(query_key), "reached"))  # so that the walks are made once
    asked = queries.select(query_key, vector).filter(usable(F.col(vector))).join(reached, query_key, "left")
    return knn_topk(vectors.filter(usable(F.col(vector))), asked, k, key, query_key, vector, block, "reached")
