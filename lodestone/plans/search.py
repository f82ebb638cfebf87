"""Questions to answers over a stored index."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answering, dense, evaluation, fusion, graph, sparse
from ..operators.clients import semantic_by
from ..session import importable
from .store import exists, load_sparse


class Engine:
    """Retrieval and answering over the tables of one index; with `approximate`, dense search walks its proximity graph (`store.write_graph`)."""

    def __init__(self, spark: SparkSession, path: str, embedder: dense.Embedder | None = None, window: int = 1, approximate: bool = False):
        self.spark, self.embedder, self.window = importable(spark), embedder, window
        if approximate and not exists(spark, f"{path}/graph"):
            raise FileNotFoundError(f"{path} holds no graph; write one first")
        self.graph = spark.read.parquet(f"{path}/graph") if approximate else None
        self.index = load_sparse(spark, path)
        self.chunks = spark.read.parquet(f"{path}/chunks")
        self.vectors = spark.read.parquet(f"{path}/vectors")

    def query_bm25(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return sparse.bm25_topk(self.index, queries, k)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank by the vectors alone."""
        asked = dense.embed(queries.filter(F.trim("question") != ""), "question", self.embedder)
        if self.graph is not None:
            return graph.graph_topk(self.graph, asked, k).drop("compared")
        return dense.knn_topk(self.vectors, asked, k, key="chunk_id")

    def query_dense(self, queries: DataFrame, k: int = 5) -> DataFrame:
        return fusion.attach_linked(self.nearest(queries, k), self.chunks, self.window)

    def hybrid(self, queries: DataFrame, k: int = 5) -> DataFrame:
        hits = fusion.hybrid_search(lambda n: self.nearest(queries, n), lambda n: self.query_bm25(queries, n), k)
        return fusion.attach_linked(hits, self.chunks, self.window)

    def retriever(self, kind: str = "hybrid", k: int = 7) -> Callable[[DataFrame], DataFrame]:
        if kind not in ("dense", "bm25", "hybrid"):
            raise ValueError(f"unknown retrieval {kind}")
        if k < 1:
            raise ValueError("top_k must be at least 1")

        def retrieve(queries: DataFrame) -> DataFrame:
            if kind == "bm25":
                hits = self.query_bm25(queries, k).withColumn("linked", F.array().cast("array<string>"))
            else:
                hits = self.query_dense(queries, k) if kind == "dense" else self.hybrid(queries, k)
            return fusion.flatten_hits(hits)

        return retrieve

    def answer(self, queries: DataFrame, generator: answering.Generator, mode: str = "iterative", retrieval: str = "hybrid", k: int = 7, judge: bool = False,
               semantic: Callable[[Column, Column], Column] | None = None, estimator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Answers; with `judge`, agreement of sampled answers decides whether they stand.  Their meaning is
        compared by `semantic`, by default by the cosine of the engine's own vectors; `estimator`
        (questions with their context to query_id, confidence, should_refuse) takes the place of all that."""
        retrieve = self.retriever(retrieval, k)
        out = answering.answer_questions(queries, retrieve, self.chunks, generator, mode)
        if not judge:
            return out
        return answering.apply_confidence(out, self.judged(queries, retrieve, generator, semantic, estimator))

    def judged(self, queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generator: answering.Generator,
               semantic: Callable[[Column, Column], Column] | None = None, estimator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The questions' confidence."""
        asked = queries.select("query_id", "question").join(answering.contexts(retrieve(queries), self.chunks), "query_id", "left")
        if estimator is not None:
            return estimator(asked)
        samples = answering.sampled(asked, generator)
        similar = semantic or semantic_by(self.embedder or dense.hashing_embedder())
        return answering.confidence(samples, answering.agreement_pairs(samples, semantic=similar))

    def answer_conditions(self, queries: DataFrame, generator: answering.Generator, k: int = 7, judge: bool = False) -> DataFrame:
        """The answers of an ablation's conditions in one frame, with condition_id: a question is retrieved and first answered
        once for each kind of retrieval, and its confidence goes with that kind."""
        conditions = evaluation.conditions(self.spark)
        retrieve = {kind: self.retriever(kind, k) for kind in dict.fromkeys(c.retrieval for c in evaluation.CONDITIONS)}
        out = answering.answer_conditions(queries, retrieve, self.chunks, generator, conditions)
        if not judge:
            return out
        kinds = [self.judged(queries, run, generator).withColumn("retrieval", F.lit(kind)) for kind, run in retrieve.items()]
        each = reduce(lambda a, b: a.unionByName(b), kinds).join(F.broadcast(conditions.select("condition_id", "retrieval")), "retrieval").drop("retrieval")
        return answering.apply_confidence(out, each, ("query_id", "condition_id"))
