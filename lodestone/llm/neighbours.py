"""Operator 4: nearest neighbours by vantage-point trees, one for each shard of the vectors.

1.  A tree of few levels, fitted on a bounded sample (`SAMPLE` rows, those of the smallest hash of
    the id), deals all rows to shards by their distances to its vantage points.  A shard of
    more than `shard_rows` rows is cut by a hash of the id.  Every row is indexed.
2.  Each query searches the shard in which it lies; the distance of the k-th nearest there bounds
    what it looks for.
3.  Queries go to the other shards that the triangle inequality does not put further away, and
    search their trees in the same way: a side of a node is passed over if its bound exceeds the
    k-th distance so far.  Bounds are multiplied by `factor`: 1 is exact, more passes over more.
4.  The shards' answers, scored with the original vectors in double precision, are merged.

Candidates are ordered by that score and, where it is equal, by the smaller id at every step, so
ties between different vectors come out right.  Rows that share a vector are one point with their
k + 1 smallest ids, which are all that can be answered; the rest are left out before the shuffle,
so any number of copies costs one point.

Null, empty and zero vectors, those with null or non-finite components, and rows without id take
no part.  Vectors of any length are read whole; only those of the same length are compared.  Rows
that repeat a query's id are not its neighbours; an id with several vectors is a query with each.
An empty table gives an empty table.  Columns beside id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, written

LEAF = 64
#: Rows of a shard, rows on which the upper tree is fitted, and the pruning factor of the query.
SHARD_ROWS, SAMPLE, FACTOR = 10_000, 20_000, 5.0
#: Queries that a task holds beside a shard.
QUERIES = 20_000
#: Slack of bounds and of scores by matrix products.
SLACK, CLOSE = 1e-9, 1e-12


def _distance(cosine: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors; infinite for -inf."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, always by the same operations."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Router:
    """The upper levels of a vantage-point tree: a complete binary tree over unit vectors."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.depth = max(0, min(int(np.ceil(np.log2(max(1, leaves)))), int(np.log2(max(1, len(sample) // 8)))))
        nodes, self.vantage, self.cut = {1: np.arange(len(sample))}, {}, {}
        for node in range(1, 1 << self.depth):
            at = nodes.pop(node)
            # of a few points the one whose distances spread most
            tried = [sample[i] for i in random.choice(at, min(8, len(at)), replace=False)] if len(at) else [sample[0]]
            spread = [_distance(sample[at] @ v) for v in tried]
            best = int(np.argmax([d.std() if len(d) else 0 for d in spread]))
            self.vantage[node], d = tried[best], spread[best]
            self.cut[node] = float(np.median(d)) if len(d) else 0.0
            nodes[2 * node], nodes[2 * node + 1] = at[d <= self.cut[node]], at[d > self.cut[node]]

    def leaf(self, unit: np.ndarray) -> np.ndarray:
        node = np.ones(len(unit), dtype=np.int64)
        for _ in range(self.depth):
            for n in np.unique(node):
                at = np.flatnonzero(node == n)
                node[at] = 2 * n + (_distance(unit[at] @ self.vantage[n]) > self.cut[n])
        return node

    def reachable(self, unit: np.ndarray, radius: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf) that bounds do not rule out."""
        who, node = np.arange(len(unit)), np.ones(len(unit), dtype=np.int64)
        for _ in range(self.depth):
            d = np.empty(len(who))
            for n in np.unique(node):
                at = np.flatnonzero(node == n)
                d[at] = _distance(unit[who[at]] @ self.vantage[n])
            cut = np.array([self.cut[n] for n in node.tolist()])
            near, far = factor * (d - cut) <= radius[who] + SLACK, factor * (cut - d) <= radius[who] + SLACK
            who, node = np.concatenate([who[near], who[far]]), np.concatenate([2 * node[near], 2 * node[far] + 1])
        return who, node


class VantageTree:
    """Tree over vectors by the distance of their directions; `ids`: the smallest of each point."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, seed: int = 7):
        self.points, self.ids, self.random = points, ids, np.random.default_rng(seed)
        self.unit = _unit(points) if len(points) else points
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        vantage = self.unit[at[self.random.integers(len(at))]]
        d = _distance(self.unit[at] @ vantage)
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        near, far = order[:half], order[half:]
        bounds = (d[near[0]], d[near[-1]], d[far[0]], d[far[-1]])
        return vantage, bounds, self._build(at[near]), self._build(at[far])

    def search(self, queries: np.ndarray, k: int, factor: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Points and scores of each query's k best by score and id (-1: none), and the points
        compared.  `least`: a score that answers have to reach."""
        self.asked, self.k = queries, k
        self.direction = _unit(queries) if len(queries) else queries
        self.floor = np.full(len(queries), -np.inf) if least is None else least
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, dtype=np.int64)
        self.compared = 0
        if len(self.points) and len(queries):
            self._visit(self.root, np.arange(len(queries)), factor)
        return self.found, self.best, self.compared

    def _leaf(self, node: np.ndarray, who: np.ndarray) -> None:
        self.compared += len(node) * len(who)
        cosines = self.direction[who] @ self.unit[node].T
        bar = np.maximum(self.best[who, -1], self.floor[who])
        if len(node) > self.k:  # others of this leaf alone rule it out
            bar = np.maximum(bar, np.partition(cosines, -self.k, axis=1)[:, -self.k])
        q, p = np.nonzero(cosines >= bar[:, None] - CLOSE)
        if not len(q):
            return
        asked = np.unique(q)
        q, point = who[q], node[p]
        exact = scores(self.asked[q], self.points[point])
        held = who[asked]
        old_q, old = np.repeat(held, self.k), self.found[held].ravel()
        q, point = np.concatenate([q, old_q[old >= 0]]), np.concatenate([point, old[old >= 0]])
        exact = np.concatenate([exact, self.best[held].ravel()[old >= 0]])
        order = np.lexsort((self.ids[point], -exact, q))
        q, point, exact = q[order], point[order], exact[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        top = nth < self.k
        self.found[q[top], nth[top]], self.best[q[top], nth[top]] = point[top], exact[top]

    def _visit(self, node, who: np.ndarray, factor: float) -> None:
        if isinstance(node, np.ndarray):
            return self._leaf(node, who)
        vantage, (near_low, near_high, far_low, far_high), near, far = node
        d = _distance(self.direction[who] @ vantage)
        near_bound = np.maximum(np.maximum(d - near_high, near_low - d), 0)
        far_bound = np.maximum(np.maximum(d - far_high, far_low - d), 0)
        first_near = near_bound <= far_bound
        for side, mask in ((near, first_near), (far, ~first_near), (near, ~first_near), (far, first_near)):
            bound = near_bound if side is near else far_bound
            limit = _distance(np.maximum(self.best[who, -1], self.floor[who])) + SLACK
            go = mask & (bound * factor <= limit)
            if go.any():
                self._visit(side, who[go], factor)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def search_shard(vectors: pa.Table, queries: pa.Table, k: int, factor: float) -> tuple[list[np.ndarray], int]:
    """query_id, qvec (the query's number), vec_id, score of each query's k best rows in a shard; points compared."""
    points, ids = _matrix(vectors["vector"]), vectors["id"].to_numpy()
    asked, ask_ids, numbers = _matrix(queries["vector"]), queries["id"].to_numpy(), queries["number"].to_numpy()
    order = np.lexsort((ids, *points.T[::-1]))  # equal vectors side by side, ids ascending
    points, ids = points[order], ids[order]
    new = np.concatenate([[True], (points[1:] != points[:-1]).any(axis=1)])
    start = np.append(np.flatnonzero(new), len(ids))
    tree = VantageTree(points[start[:-1]], ids[start[:-1]])
    found, score, compared = tree.search(asked, k + 1, factor, queries["least"].to_numpy())
    q, slot = np.nonzero(found >= 0)
    point, score = found[q, slot], score[q, slot]
    members = np.minimum(np.diff(start)[point], k + 1)
    q, point, score = np.repeat(q, members), np.repeat(point, members), np.repeat(score, members)
    nth = np.arange(len(q)) - np.repeat(np.cumsum(members) - members, members) if len(members) else np.zeros(0, np.int64)
    row = start[point] + nth
    other = ids[row] != ask_ids[q]
    q, row, score = q[other], row[other], score[other]
    order = np.lexsort((ids[row], -score, q))
    q, row, score = q[order], row[order], score[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return [ask_ids[q[top]], numbers[q[top]], ids[row[top]], score[top]], compared


def usable(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vector (doubles) and length of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = frame.select(F.col(key).cast("long").alias("id"), v.alias("vector"))
    # products as they will be used: a vector too small or large for a norm has no direction
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rows.filter(F.col("id").isNotNull() & fine & (square > 0) & (square < float("inf"))).withColumn("length", F.size("vector"))


def nearest(
    frame: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, sample: int = SAMPLE,
    most_queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the frame nearest to each query row.  The queries of a shard take turns of about
    `most_queries`, so what a task holds grows with neither side."""
    ready(frame.sparkSession)
    if factor < 1:
        raise ValueError("factor is at least 1")
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    rows = usable(frame, key, vector).withColumn("copy", copy).filter(F.col("copy") <= k + 1).drop("copy")
    rows = written(rows.dropDuplicates(["id", "vector"]), "vectors")
    drawn: dict[int, list] = {}
    for r in rows.select("length", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect():  # a bounded sample
        drawn.setdefault(r.length, []).append(r.vector)
    counts = {r.length: r["count"] for r in rows.filter(F.col("length").isin(list(drawn))).groupBy("length").count().collect()}  # as many as in the sample at most
    routers = {n: Router(_unit(np.array(vs)), -(-counts[n] // shard_rows)) for n, vs in drawn.items()}

    def by_length(batch: pa.RecordBatch, then) -> Iterator[pa.RecordBatch]:
        lengths = np.asarray(batch.column("length"))
        for n in np.unique(lengths):
            part = batch.filter(pa.array(lengths == n))
            yield then(part, routers.get(int(n)))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(part: pa.RecordBatch, router: Router | None) -> pa.RecordBatch:
            leaf = np.ones(part.num_rows, np.int64) if router is None else router.leaf(_unit(_matrix(part.column("vector"))))
            return part.append_column("leaf", pa.array(leaf))

        for batch in batches:
            yield from by_length(batch, of)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(part: pa.RecordBatch, router: Router | None) -> pa.RecordBatch:
            who, leaf = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if router is not None:
                radius = _distance(np.asarray(part.column("least")))
                who, leaf = router.reachable(_unit(_matrix(part.column("vector"))), radius, factor)
                away = leaf != np.asarray(part.column("leaf"))[who]
                who, leaf = who[away], leaf[away]
            return part.take(pa.array(who)).set_column(part.schema.get_field_index("leaf"), "leaf", pa.array(leaf))

        for batch in batches:
            yield from by_length(batch, of)

    row = "id long, vector array<double>, length int, leaf long"
    dealt = written(rows.mapInArrow(home, row), "dealt")
    blocks = written(dealt.groupBy("length", "leaf").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("blocks")), "blocks")
    shards = dealt.join(blocks, ["length", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "vector", "length", "leaf", "block")
    shards = shards.toDF(*shards.columns)  # columns of their own, apart from those of the queries' side
    # queries have a number of their own, since an id may come with several vectors
    asked = usable(queries, key, vector).dropDuplicates(["id", "vector"]).withColumn("number", F.xxhash64("id", "vector"))
    asked = asked.select("id", "vector", "length", "number", F.lit(float("-inf")).alias("least"))
    placed = written(asked.mapInArrow(home, "id long, vector array<double>, length int, number long, least double, leaf long"), "queries")

    def work(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        columns = [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)]
        if vectors.num_rows and asked.num_rows:
            columns, _ = search_shard(vectors, asked, k, factor)
        return pa.table([pa.array(c) for c in columns], names=["query_id", "number", "vec_id", "score"])

    def searched(rows: DataFrame, turns: DataFrame) -> DataFrame:
        """turns: length, leaf and the number of turns of the leaf's queries."""
        every = rows.join(blocks.join(turns, ["length", "leaf"]), ["length", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        every = every.withColumn("turn", F.pmod(F.xxhash64("number"), F.col("turns")).cast("int"))
        copies = shards.join(turns, ["length", "leaf"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        copies = copies.toDF(*copies.columns)
        pairs = copies.groupBy("length", "leaf", "block", "turn").cogroup(every.groupBy("length", "leaf", "block", "turn"))
        return pairs.applyInArrow(work, "query_id long, number long, vec_id long, score double")

    def top(found: DataFrame, by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    own = placed.groupBy("length", "leaf").agg(F.ceil(F.count("*") / most_queries).cast("int").alias("turns"))
    first = written(top(searched(placed, own), "number"), "first")
    reached = first.filter(F.col("rank") == k).select("number", F.col("score").alias("reached"))
    more = placed.join(reached, "number", "left").withColumn("least", F.coalesce("reached", "least")).select(*placed.columns)
    # any query may reach any leaf
    most = blocks.select("length", "leaf", F.lit(max(1, -(-placed.count() // most_queries))).alias("turns"))
    second = searched(more.mapInArrow(others, placed.schema), most)
    # one answer for each id: of an id with several vectors the best rows of all
    best = first.drop("rank").unionByName(second).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top(best, "query_id").select("query_id", "rank", "vec_id", "score")
