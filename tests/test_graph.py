import numpy as np
import pytest

from lodestone.operators import dense, graph
from lodestone.plans import store
from lodestone.plans.search import Engine


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cloud(kind: str, n: int, seed: int = 0):
    r = np.random.default_rng(seed)
    if kind == "uniform":
        return unit(r.normal(size=(n, 32))), unit(r.normal(size=(150, 32)))
    centres = r.normal(size=(60, 32))
    return unit(centres[r.integers(0, 60, n)] + 0.3 * r.normal(size=(n, 32))), unit(centres[r.integers(0, 60, 150)] + 0.3 * r.normal(size=(150, 32)))


@pytest.mark.parametrize("kind, most", [("uniform", 0.4), ("clusters", 0.25)])
def test_recall_and_share_of_a_shard(kind, most):
    points, queries = cloud(kind, 8000)
    links = graph.linked(points)
    exact = np.sort(-(queries @ points.T), axis=1)[:, :10]
    ids, scores, compared = graph.walk(points, links, queries, 10)
    assert np.allclose(scores, np.einsum("qkd,qd->qk", points[ids], queries))
    assert np.mean(scores >= -exact[:, 9:] - 1e-9) >= 0.95 and compared.mean() / 8000 < most
    narrow = graph.walk(points, links, queries, 10, beam=16)
    assert narrow[2].mean() < compared.mean() / 2


def test_links_point_in_different_directions():
    points = unit(np.array([[1, 0.0, 0], [1, 0.1, 0], [1, 0.11, 0], [1, 0, 0.12]]))
    links = graph.linked(points, degree=2, candidates=3, random=0)
    assert links[0, :2].tolist() == [1, 3]  # 2 is nearer to 1 than to 0
    assert graph.linked(points[:1]).tolist() == [[-1]]


def test_recall_over_several_shards_and_blocks(spark):
    points, queries = cloud("clusters", 3000, 4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    table = graph.build_graph(rows, shard_rows=700)
    assert table.select("shard").distinct().count() == 5
    found = graph.graph_topk(table, asked, 10, beam=64, block=40).collect()
    exact = {(r.query_id, r.doc_id) for r in dense.knn_topk(rows, asked, 10).collect()}
    assert len(found) == 1500 and len({(r.query_id, r.doc_id) for r in found} & exact) / 1500 >= 0.95
    assert {r.rank for r in found} == set(range(1, 11)) and np.mean([r.compared for r in found]) < 0.7 * 3000
    again = graph.graph_topk(graph.build_graph(rows.repartition(2), shard_rows=700), asked.repartition(3), 10, beam=64, block=1000).collect()
    assert {(r.query_id, r.doc_id, r.rank) for r in again} == {(r.query_id, r.doc_id, r.rank) for r in found}


def test_confirmed_walks_are_exact(spark):
    points, queries = cloud("uniform", 3000, 6)
    points[2990:] = points[:10]  # copies: ties go to the smaller key
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*points[:10], *queries[:60]])], "query_id long, embedding array<double>")
    found = graph.graph_topk(graph.build_graph(rows), asked, 10, beam=10)
    pairs = lambda frame: {(r.query_id, r.rank, r.doc_id) for r in frame.collect()}
    scores = unit(np.array([*points[:10], *queries[:60]])) @ unit(points).T
    best = {(q, n + 1, int(i)) for q, s in enumerate(scores) for n, i in enumerate(np.lexsort((np.arange(3000), -np.round(s, 9)))[:10])}
    assert pairs(found) != best
    for block in (4096, 50):
        assert pairs(graph.confirmed_topk(found, rows, asked, 10, block=block)) == best
    few = graph.graph_topk(graph.build_graph(rows.filter("vec_id < 4")), asked, 10)
    assert graph.confirmed_topk(few, rows.filter("vec_id < 4"), asked, 10).count() == 70 * 4


def test_ties_copies_and_vectors_without_direction(spark):
    bad = [(50, None), (51, []), (52, [0.0, 0.0]), (53, [float("nan"), 1.0]), (54, [None, 1.0]), (55, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)] + [(40, [0.0, 2.0])] + bad, "vec_id long, embedding array<double>")
    table = graph.build_graph(rows)
    asked = rows.withColumnRenamed("vec_id", "query_id").filter("query_id IN (3, 40, 50, 52, 53) OR query_id IS NULL")
    found = {(r.query_id, r.rank): r.doc_id for r in graph.graph_topk(table, asked, 3).collect()}
    assert found == {(3, 1): 0, (3, 2): 1, (3, 3): 2, (40, 1): 40, (40, 2): 0, (40, 3): 1}
    assert graph.graph_topk(table, asked, 0).collect() == [] and graph.graph_topk(graph.build_graph(rows.limit(0)), asked, 3).collect() == []
    assert len(graph.graph_topk(graph.build_graph(rows.filter("vec_id = 40")), asked, 3).collect()) == 2


def test_engine_walks_a_stored_graph(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(f"c{i}", f"f{i}.py", f"name_{i}", 1, 2, "", f"def name_{i}(): return 'word{i} other{i % 7}'", "python") for i in range(60)],
        "id string, filepath string, function_name string, start_line int, end_line int, docstring string, source string, language string",
    )
    path = str(tmp_path / "index")
    store.write_index(chunks, path)
    with pytest.raises(FileNotFoundError):
        Engine(spark, path, approximate=True)
    store.write_graph(spark, path)
    asked = spark.createDataFrame([("q", "where is word12 used with other5"), ("r", "name_3")], "query_id string, question string")
    rows = lambda frame: [(r.query_id, r.doc_id, r.rank) for r in frame.orderBy("query_id", "rank").collect()]
    exact, near = Engine(spark, path), Engine(spark, path, approximate=True)
    assert rows(near.query_dense(asked, 5)) == rows(exact.query_dense(asked, 5))
    assert rows(near.hybrid(asked, 5)) == rows(exact.hybrid(asked, 5))
    store.replace_chunks(spark, path, chunks.limit(0), chunks.limit(1))
    assert not store.exists(spark, f"{path}/graph")
