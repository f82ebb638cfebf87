import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ordering, sparse
from lodestone.plans import store
from lodestone.streaming import refresh

from .test_operators import bm25_model


def corpus(n: int, seed: int = 1) -> dict[int, str]:
    """Documents in which a few terms stand nearly everywhere and many hardly anywhere."""
    r = random.Random(seed)
    often = ["the", "of", "and", "code"]
    return {i: " ".join(r.choice(often) if r.random() < 0.6 else f"rare{int(r.paretovariate(0.7)) % 997}" for _ in range(r.randint(0, 40))) for i in range(n)}


QUESTIONS = [("often", "the of and code"), ("mixed", "code rare3 the rare7"), ("rare", "rare1 rare2 rare2 rare500"), ("one", "the"), ("none", "absent"), ("blank", " ")]


@pytest.fixture(scope="module")
def indexed(spark):
    docs = corpus(900)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return docs, sparse.build(frame), spark.createDataFrame(QUESTIONS, "query_id string, question string")


@pytest.mark.parametrize("block, most", [(200_000, sparse.ASKED_TERMS), (60, sparse.ASKED_TERMS), (200_000, 2)])
def test_pruned_and_joined_scores_against_plain_python(indexed, monkeypatch, block, most):
    """Very frequent terms among them; in blocks of few hits nearly all documents are passed over; beyond `most` terms the join takes over."""
    monkeypatch.setattr(sparse, "BLOCK_HITS", block)
    docs, index, queries = indexed
    split = {i: t.split() for i, t in docs.items()}
    found = {}
    for r in sorted(sparse.bm25_topk(index, queries, 7, most=most).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((round(r.score, 9), r.doc_id))
    for name, text in QUESTIONS[:4]:
        assert found[name] == bm25_model(split, [t for t in text.split() if t not in ("the", "of", "and")] or text.split())[:7], name
    assert set(found) <= {n for n, _ in QUESTIONS[:4]}


def test_documents_that_cannot_enter_are_not_scored():
    """A weak term alone can't bring a document in, and a block whose bounds stay below the k-th score is passed over."""
    import numpy as np

    ids = np.array([10, 11, 12, 13], dtype=object)
    weak, strong = (np.arange(4), np.full(4, 0.1), 0.1), (np.array([2]), np.array([5.0]), 5.0)
    first = sparse.best_of_block((np.zeros(0), np.zeros(0, dtype=object)), [(0, 1.0), (1, 1.0)], {0: weak, 1: strong}, ids, 2)
    assert first[1].tolist() == [12, 10] and first[2] == 4
    best = (np.array([6.0, 4.0]), np.array([1, 2], dtype=object))
    scores, names, scored = sparse.best_of_block(best, [(0, 1.0), (1, 1.0)], {0: weak, 1: strong}, ids, 2)
    assert scored == 1 and names.tolist() == [1, 12] and scores[1] == pytest.approx(5.1)
    assert sparse.best_of_block(best, [(0, 1.0)], {0: weak}, ids, 2)[2] == 0
    # a tie with the k-th score must still come in, as its id may be smaller
    tie = sparse.best_of_block((np.array([6.0, 5.0]), np.array([1, 99], dtype=object)), [(1, 1.0)], {1: strong}, ids, 2)
    assert tie[1].tolist() == [1, 12]


def test_each_task_hands_on_k_rows_at_most(indexed):
    _, index, queries = indexed
    known = sparse.question_terms(queries).join(index.terms.select("term", "idf"), "term").collect()
    from pyspark.sql import types as T

    out = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = sparse.pruned_topk(index, known, 3, out).withColumn("part", F.spark_partition_id())
    assert rows.groupBy("query_id", "part").count().agg(F.max("count")).first()[0] <= 3


def test_texts_are_read_twice_for_a_search(spark, tmp_path):
    """Once for the corpus counts, which are stored, and once to score."""
    spark.createDataFrame(list(corpus(50).items()), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    index = sparse.build(spark.read.parquet(str(tmp_path / "docs")))
    plan = sparse.bm25_topk(index, spark.createDataFrame(QUESTIONS, "query_id string, question string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("doc_id#") and plan.count("Relation [doc_id#") <= 1


def terms_of(index) -> dict:
    stats = index.stats.first()
    return {r.term: (r.df, round(r.idf, 9)) for r in index.terms.collect()} | {None: (stats.n_docs, round(stats.avg_len, 9))}


def test_batches_count_once(spark, tmp_path):
    docs = spark.createDataFrame(list(corpus(120, 3).items()), "doc_id long, text string")
    path, whole = str(tmp_path / "index"), terms_of(sparse.build(docs))
    with pytest.raises(FileNotFoundError):
        refresh.live_index(spark, path)
    refresh.add_batch(docs.filter("doc_id < 50"), 0, path)
    refresh.add_batch(docs.filter("doc_id >= 30 AND doc_id < 90"), 1, path)
    # a batch that failed before its deltas were written does not count, and comes again
    sparse.counted_documents(docs.limit(5)).write.parquet(f"{path}/counted/batch=2")
    assert refresh.batches(spark, path) == [0, 1] and terms_of(refresh.live_index(spark, path)) == terms_of(sparse.build(docs.filter("doc_id < 90")))
    for _ in range(2):
        refresh.add_batch(docs, 2, path)
    refresh.add_batch(docs.limit(0), 3, path)
    index = refresh.live_index(spark, path)
    assert terms_of(index) == whole and index.documents.count() == 120
    top = sparse.bm25_topk(index, spark.createDataFrame(QUESTIONS, "query_id string, question string"), 3)
    assert {tuple(r)[:2] for r in top.collect()} == {tuple(r)[:2] for r in sparse.bm25_topk(sparse.build(docs), spark.createDataFrame(QUESTIONS, "query_id string, question string"), 3).collect()}


def test_stream_grows_an_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string")
    for _ in range(2):
        docs.write.mode("append").parquet(str(tmp_path / "docs"))
        refresh.refresh_index(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    index = refresh.live_index(spark, str(tmp_path / "index"))
    assert {(r.doc_id, r.term): r.tf for r in index.postings.collect()} == {(1, "a"): 2, (1, "b"): 1, (2, "c"): 1}
    assert terms_of(index) == terms_of(sparse.build(docs))


def test_counts_are_merged_and_taken_out(spark):
    docs = spark.createDataFrame(list(corpus(60, 5).items()), "doc_id long, text string")
    counts = lambda f: sparse.corpus_counts(sparse.counted_documents(f))
    left = sparse.merged_counts(counts(docs), sparse.negated(counts(docs.filter("doc_id % 4 = 1"))))
    assert {tuple(r) for r in left.collect()} == {tuple(r) for r in counts(docs.filter("doc_id % 4 <> 1")).collect()}


@pytest.fixture()
def repository(tmp_path):
    files = {"a.py": "def first(x):\n    return x\n\n\ndef second(y):\n    return y + 1\n", "b.py": "def third():\n    return 'other words'\n", "README.md": "# Title\nSome text.\n"}
    for name, text in files.items():
        (tmp_path / "repo").mkdir(exist_ok=True)
        (tmp_path / "repo" / name).write_text(text)
    return tmp_path / "repo"


def test_update_touches_only_what_changed(spark, repository, tmp_path):
    from lodestone.operators.dense import hashing_embedder

    seen = spark.sparkContext.accumulator(0)

    def embedder(texts):
        seen.add(len(texts))
        return hashing_embedder()(texts)

    path, other = str(tmp_path / "index"), str(tmp_path / "other")
    store.build_index(spark, str(repository), path, embedder=embedder)
    before = seen.value
    manifest, change = store.update_index(spark, path, embedder)
    assert change == store.Change(0, 0, 0) and seen.value == before
    (repository / "a.py").write_text("def first(x):\n    return x\n\n\ndef second(y):\n    return y + 2 * third()\n")
    (repository / "b.py").unlink()
    (repository / "c.py").write_text("class Fourth:\n    pass\n")
    manifest, change = store.update_index(spark, path, embedder)
    assert change == store.Change(files=3, added=2, gone=2) and seen.value == before + 2
    full = store.build_index(spark, str(repository), other)
    assert (manifest["fingerprint"], manifest["chunk_count"]) == (full["fingerprint"], full["chunk_count"])
    for name in ("chunks", "counted", "counts", "terms", "stats", "files"):
        rows = [sorted(map(str, spark.read.parquet(f"{p}/{name}").select(sorted(spark.read.parquet(f"{p}/{name}").columns)).collect())) for p in (path, other)]
        assert rows[0] == rows[1], name
    vectors = [sorted((r.chunk_id, tuple(r.embedding)) for r in spark.read.parquet(f"{p}/vectors").collect()) for p in (path, other)]
    assert vectors[0] == vectors[1]
    assert store.load_or_build(spark, str(repository), path)["fingerprint"] == manifest["fingerprint"]
    # other options, and an index left without a manifest, are built anew
    (repository / "c.py").unlink()
    assert store.load_or_build(spark, str(repository), path, exclude_tests=True)["exclude_tests"] is True
    store.remove_path(spark, f"{path}/manifest.json")
    assert store.load_or_build(spark, str(repository), path)["exclude_tests"] is False


def test_places_with_ties_and_few_rows(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("w")).repartition(6)
    found = {r.id: r.place for r in ordering.positions(frame, F.desc("v"), F.asc("w"), F.asc("id"), name="place", partitions=5).collect()}
    wanted = sorted(((-(i % 7), (0, 0) if i % 5 == 0 else (1, i % 11), i) for i in range(1000)))
    assert found == {i: n for n, (*_, i) in enumerate(wanted, 1)}
    assert ordering.positions(frame.limit(0), F.asc("id")).collect() == []
    assert [r.position for r in ordering.positions(spark.createDataFrame([(1,)] * 4, "x int"), F.asc("x")).orderBy("position").collect()] == [1, 2, 3, 4]


def test_digest_depends_on_the_order_alone(spark):
    import hashlib

    rows = [(i, hashlib.sha256(str(i * i).encode()).hexdigest()) for i in range(500)]
    digest = lambda rows, parts, n: ordering.ordered_digest(spark.createDataFrame(rows, "at long, d string").repartition(parts), "d", F.asc("at"), partitions=n).first().fingerprint
    one = digest(rows, 1, 1)
    assert {digest(rows, p, n) for p, n in ((3, 2), (5, 7), (2, 400))} == {one}
    swapped = [(i, rows[{7: 8, 8: 7}.get(i, i)][1]) for i, _ in rows]
    assert digest(swapped, 3, 4) != one and digest(rows[:-1], 3, 4) != one
    assert len(ordering.ordered_digest(spark.createDataFrame([], "at long, d string"), "d", F.asc("at")).first().fingerprint) == 64
