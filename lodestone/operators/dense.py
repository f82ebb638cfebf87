"""Dense retrieval: embedding texts, the embedding cache, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import text_hash, text_or_empty

Embedder = Callable[[list[str]], list[list[float]]]

#: Queries of a block and rows of a shard; queries and points that are multiplied at once; scores nearer than that may be equal after rounding;
#: points of a tile that are multiplied one by one with a query.
BLOCK, SHARD = 8192, 50_000
TOGETHER, TILE, EQUAL, FEW = 512, 4096, 2e-9, 16


def embedding_text() -> Column:
    """What of a chunk is embedded."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("path: "), F.col("filepath")),
        F.concat(F.lit("symbol: "), F.col("function_name")),
        F.concat(F.lit("language: "), F.col("language")),
        F.when(text_or_empty(F.col("docstring")) != "", F.concat(F.lit("docstring: "), F.col("docstring"))),
        F.concat(F.lit("source:\n"), F.col("source")),
    )


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """A deterministic built-in embedder: signed hashed words, unit length."""
    import re
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for word in re.findall(r"[A-Za-z0-9]+", text.lower()):
                h = zlib.crc32(word.encode())
                out[i, h % dimensions] += 1.0 if h & 0x80000000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()

    return embed


def embed(frame: DataFrame, text: str, embedder: Embedder | None = None, batch: int = 16, out: str = "embedding") -> DataFrame:
    """The frame with a vector of each text; the embedder is called with Arrow batches."""
    call = embedder or hashing_embedder()
    call = getattr(call, "embed_texts", call)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            held: list = []
            for a in range(0, len(texts), batch):
                part = texts.iloc[a : a + batch].fillna("").tolist()
                found = list(call(part))
                if len(found) != len(part):
                    raise ValueError("the embedder must give one vector for each text")
                held += found
            yield pd.Series([[float(x) for x in v] for v in held], dtype=object)

    return frame.withColumn(out, vectors(F.col(text)))


def embed_missing(chunks: DataFrame, cache: DataFrame | None, model: str, embedder: Embedder | None = None, batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """Vectors of all chunks, and the newly made cache rows: chunks whose id and text are in the cache are not embedded again."""
    keyed = chunks.select(F.col("id").alias("chunk_id"), embedding_text().alias("text")).withColumn("text_sha256", text_hash(F.col("text"))).withColumn("model_name", F.lit(model))
    key = ["model_name", "chunk_id", "text_sha256"]
    fresh = keyed if cache is None else keyed.join(cache, key, "left_anti")
    fresh = embed(fresh, "text", embedder, batch).select(*key, "embedding")
    known = fresh if cache is None else fresh.unionByName(keyed.join(cache, key).select(*key, "embedding"))
    return known, fresh


def score_from_distance(distance: Column) -> Column:
    """1 - distance; 0 where there is none."""
    return F.coalesce(1.0 - distance.try_cast("double"), F.lit(0.0))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; those without length stay zero."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def in_order(ids: pa.Array, vectors: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Points by ascending id, their vectors of length one."""
    order = pc.sort_indices(ids)
    return ids.take(order), units(vectors[order.to_numpy()])


def single(x: np.ndarray) -> np.ndarray:
    """Rows in single precision; those that are no numbers are zero, which is above any score they get."""
    return np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0).astype(np.float32)


def scored(product: np.ndarray) -> np.ndarray:
    """Scores of products; vectors that are no numbers come last."""
    return product if np.isfinite(product).all() else np.where(np.isfinite(product), product, -2.0)


class Nearest:
    """The k best points so far of each of some queries (rows of length one), ties to the smaller id.

    Points come in any number of parts and are compared in tiles, so memory is bounded by queries x `TILE`.  A tile's points go
    in the order of their ids; of each query at most k of a tile are kept, and after the first tile only those
    that reach the k-th score so far, or the one that is known to be reached (`least`).  A tile is multiplied in single precision first;
    what may reach that score by the bound of its error (`slack`) is multiplied again in double precision, which alone decides.
    """

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray):
        self.queries, self.k, self.least = queries, k, least.reshape(-1, 1)
        self.rough, self.slack = single(queries), (queries.shape[1] + 4) * float(np.finfo(np.float32).eps)
        self.scores, self.places = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, np.int64)
        self.ids: pa.Array | None = None  # of all points in `places`, those of the best alone after each part

    def add(self, ids: pa.Array, vectors: np.ndarray) -> None:
        """Points by id and vector, in any order."""
        self.add_ordered(*in_order(ids, vectors))

    def add_ordered(self, part: pa.Array, points: np.ndarray) -> None:
        """Points as `in_order` gives them."""
        held = 0 if self.ids is None else len(self.ids)
        # new and held ids as numbers in one order, so that ties are settled without the ids themselves
        both = part if self.ids is None else pa.concat_arrays([self.ids, part])
        rank = np.empty(len(both), np.int64)
        rank[pc.sort_indices(both).to_numpy()] = np.arange(len(both))
        a, width = 0, TILE if held else -(-TILE // 16)  # the first tiles are small, so that there soon is a score to reach
        while a < len(points):
            row, col, score = self._fit(points[a : a + width], np.maximum(self.scores[:, -1:], self.least) - EQUAL)
            if len(row):
                self._merge(row, held + a + col, score, rank)
            a, width = a + width, min(2 * width, TILE)
        used = np.unique(self.places[self.places >= 0])
        self.places = np.where(self.places >= 0, np.searchsorted(used, self.places), -1)
        self.ids = both.take(pa.array(used))

    def _fit(self, points: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries and columns of a tile that may be among the best, at most k for each query, and their scores."""
        bounded = np.flatnonzero(least[:, 0] > -np.inf)
        row, col = self._near(points, bounded, least[bounded])
        many = np.flatnonzero((np.bincount(row, minlength=len(least)) > min(self.k, FEW)) | (least[:, 0] == -np.inf))
        few = ~np.isin(row, many)
        row, col = row[few], col[few]
        score = scored(np.einsum("ij,ij->i", self.queries[row], points[col]))
        fit = score > least[row, 0]
        row, col, score = row[fit], col[fit], score[fit]
        if len(many):
            tile = scored(self.queries[many] @ points.T)
            r, c = self._best(tile, least[many])
            row, col, score = np.concatenate([row, many[r]]), np.concatenate([col, c]), np.concatenate([score, tile[r, c]])
        return row, col, score

    def _near(self, points: np.ndarray, bounded: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some queries the columns of a tile whose products in single precision come near their least scores."""
        rough = self.rough if len(bounded) == len(self.rough) else self.rough[bounded]
        near = np.zeros((len(rough), -(-len(points) // 8) * 8), bool)
        np.greater(rough @ single(points).T, (least - self.slack).astype(np.float32), out=near[:, : len(points)])
        eights = np.flatnonzero(near.view(np.uint64))  # few are near, so eight are looked at together
        cells = (eights[:, None] * 8 + np.arange(8)).ravel()
        row, col = np.divmod(cells[near.ravel()[cells]], near.shape[1])
        return bounded[row], col

    def _best(self, tile: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, fit = self.k, tile > least
        many = np.flatnonzero(fit.sum(axis=1) > k)
        if len(many):
            rounded = np.round(tile[many], 9)
            kth = np.partition(rounded, tile.shape[1] - k, axis=1)[:, tile.shape[1] - k, None]
            above, even = rounded > kth, rounded == kth
            fit[many] = above | (even & (np.cumsum(even, axis=1) <= k - above.sum(axis=1, keepdims=True)))  # equal ones by id
        return np.nonzero(fit)

    def _merge(self, row: np.ndarray, place: np.ndarray, score: np.ndarray, rank: np.ndarray) -> None:
        whose = np.unique(row)
        kept = self.places[whose]
        who, at = np.nonzero(kept >= 0)
        rows = np.concatenate([whose[who], row])
        places, scores = np.concatenate([kept[who, at], place]), np.concatenate([self.scores[whose][who, at], score])
        order = np.lexsort((rank[places], -np.round(scores, 9), rows))
        rows, places, scores = rows[order], places[order], scores[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = nth < self.k
        self.scores[rows[top], nth[top]], self.places[rows[top], nth[top]] = scores[top], places[top]

    def found(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Places of the queries, ids and scores of their best."""
        row, nth = np.nonzero(self.places >= 0)
        scores = self.scores[row, nth]
        ids = self.ids.take(pa.array(self.places[row, nth])) if self.ids is not None else pa.array([])
        return row, ids, np.where(scores < -1.5, np.nan, scores)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of a list column as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def in_blocks(rows: DataFrame, asked: DataFrame, k: int, out_type: T.StructType, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, doc_id, score: each shard's k nearest to each query, for any number of queries.  A task holds a block and a
    shard, a row of bytes for each part of a vector, whatever the tables' sizes; what is shuffled besides each row once are
    copies of the queries, one for each shard, and of the vectors, one for each block."""
    blocks, shards = -(-asked.count() // block), max(1, -(-rows.count() // shard))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("doc_id", "v", F.pmod(F.xxhash64("doc_id", "v"), F.lit(shards)).cast("int").alias("s"), every(blocks, "b"))
    right = asked.select("query_id", F.col("v").alias("q"), "least", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)).cast("int").alias("b"), every(shards, "s"))

    def nearest(points: pa.Table, queries: pa.Table) -> pa.Table:
        names, parts = queries["query_id"].combine_chunks(), []
        if points.num_rows and queries.num_rows:
            ids, vectors = in_order(points["doc_id"].combine_chunks(), matrix(points["v"]))
            asked_for, least = units(matrix(queries["q"])), queries["least"].to_numpy()
            for a in range(0, len(asked_for), TOGETHER):
                best = Nearest(asked_for[a : a + TOGETHER], k, least[a : a + TOGETHER])
                best.add_ordered(ids, vectors)
                row, found, scores = best.found()
                parts.append([names.take(pa.array(a + row)), found, pa.array(scores)])
        kinds = [to_arrow_type(f.dataType) for f in out_type.fields]
        return pa.table([pa.chunked_array([p[i] for p in parts], kind) for i, kind in enumerate(kinds)], names=out_type.fieldNames())

    return left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(nearest, out_type)


def knn_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", block: int = 4096, least: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: exact nearest by cosine.

    Up to `block` queries go to every partition of the vectors as one matrix; a partition puts
    out k rows for each query, so what is shuffled grows with partitions, not with vectors.
    More queries are dealt to blocks, and each meets each shard of the vectors in a task of
    one plan.  Ties go to the smaller id.  `least` is a column of the queries with a score that k points are known to
    reach (null: none known).
    """
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    rows = vectors.select(F.col(key).alias("doc_id"), F.col(vector).alias("v")).filter(F.col("doc_id").isNotNull() & F.col("v").isNotNull())
    known = F.coalesce(F.col(least).cast("double"), F.lit(float("-inf"))) if least else F.lit(float("-inf"))
    asked = queries.select(F.col(query_key).alias("query_id"), F.col(vector).alias("v"), known.alias("least")).filter(F.col("query_id").isNotNull() & F.col("v").isNotNull())
    out_type = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id")))
    collected = asked.limit(block + 1).toArrow()
    if collected.num_rows > block:
        return in_blocks(rows, asked, k, out_type).withColumn("rank", place).filter(F.col("rank") <= k)
    pa_type = [to_arrow_type(f.dataType) for f in out_type.fields]
    names = collected["query_id"].combine_chunks().cast(pa_type[0])
    shared = vectors.sparkSession.sparkContext.broadcast((names, units(matrix(collected["v"])), collected["least"].to_numpy()))  # at most `block` vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked_for, least = shared.value
        best = [Nearest(asked_for[a : a + TOGETHER], k, least[a : a + TOGETHER]) for a in range(0, len(names), TOGETHER)]
        for batch in batches:
            if batch.num_rows:
                ids, found = in_order(batch.column(0), matrix(batch.column(1)))
                for one in best:
                    one.add_ordered(ids, found)
        for a, one in zip(range(0, len(names), TOGETHER), best, strict=True):
            row, ids, scores = one.found()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a + row)), ids.cast(pa_type[1]), pa.array(scores)], out_type.fieldNames())

    return rows.mapInArrow(nearest, out_type).withColumn("rank", place).filter(F.col("rank") <= k)
