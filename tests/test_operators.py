import json
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answering, chunking, dense, evaluation, fusion, sparse
from lodestone.functions.text import REFUSAL_ANSWER
from lodestone.plans import store
from lodestone.plans.search import Engine
from lodestone.sources.repository import clone, read_eval_set, read_repository

SAMPLE = '''"""Module doc."""
import os

LIMIT = 3


@decorate
def top_level(x):
    """Say hello."""
    return handle_user(x)


class Thing:
    """A thing."""

    async def fetchData(self):
        return LIMIT
'''


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    files = {
        "app.py": SAMPLE, "pkg/__init__.py": "", "pkg/_util.py": "def handle_user(user_id):\n    return user_id\n", "bad.py": "def (\n",
        "README.md": "# Project Title\nIntro text.\n\n## Usage\nRun it with handlers.\n", "docs/guide.md": "# Guide\n", "LICENSE": "MIT",
        "tests/test_app.py": "def test_app():\n    assert True\n", "node_modules/x.py": "x = 1\n", "long.py": "x = 1\n" * 6 + "\n",
        "gen.py": "# Code generated by a tool. DO NOT EDIT\nx = 1\n", "a.min.js": "x", "other.ts": "let x",
        "math/geo.py": "def area_of_circle(radius):\n    return 3 * radius * radius\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "binary.py").write_bytes(b"a\x00b")
    (root / "latin.py").write_bytes("é".encode("latin-1"))
    return str(root)


@pytest.fixture(scope="module")
def index(spark, repository, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    return path, store.build_index(spark, repository, path, exclude_tests=True)


def test_ingest_reasons(spark, repository):
    files = chunking.ingest(read_repository(spark, repository), 5)
    reasons = {r.filepath: r.skip_reason for r in files.collect()}
    assert "node_modules/x.py" not in reasons
    assert {p for p, r in reasons.items() if r is None} == {"pkg/__init__.py", "pkg/_util.py", "bad.py", "README.md", "tests/test_app.py", "other.ts", "math/geo.py"}
    assert reasons["LICENSE"] == "license" and reasons["docs/guide.md"] == "unsupported_type" and reasons["binary.py"] == reasons["latin.py"] == "binary_or_non_utf8"
    assert reasons["gen.py"] == reasons["a.min.js"] == "generated" and reasons["long.py"] == "too_many_lines:7" and reasons["app.py"].startswith("too_many_lines")
    counts = {r.reason: r.files for r in chunking.skip_counts(files).collect()}
    assert counts["binary_or_non_utf8"] == 2 and counts["too_many_lines"] == 2
    with pytest.raises(FileNotFoundError):
        read_repository(spark, repository + "/missing")
    with pytest.raises(NotADirectoryError):
        read_repository(spark, repository + "/app.py")


def test_symbols_and_sections():
    found = {s[0]: s for s in chunking.python_symbols(SAMPLE)}
    assert list(found) == ["__module__", "top_level", "Thing", "Thing.fetchData"]
    assert found["__module__"][2:5] == (2, 4, "Module doc.") or found["__module__"][2:4] == (2, 2)
    assert found["top_level"][2:5] == (7, 10, "Say hello.") and found["Thing.fetchData"][5].strip().startswith("async def")
    assert chunking.python_symbols("def (") == []
    sections = chunking.readme_sections("First para\nmore\n\nSecond\n\n# Project Title\ntext\n\n```\n# code\n```\n## Usage\n")
    assert [(s[0], s[2], s[3]) for s in sections] == [("README:first-para", 1, 2), ("README:second", 4, 4), ("README:project-title", 6, 9), ("README:code", 10, 11), ("README:usage", 12, 12)]


def test_line_windows(spark):
    chunk = [("i", "f.py", "f", 10, 17, "", "\n".join("abcdefgh"), "python")]
    frame = spark.createDataFrame(chunk, "id string, filepath string, function_name string, start_line int, end_line int, docstring string, source string, language string")
    parts = chunking.split_oversized(frame, 4, 1).orderBy("start_line").collect()
    assert [(p.start_line, p.end_line, p.source) for p in parts] == [(10, 13, "a\nb\nc\nd"), (13, 16, "d\ne\nf\ng"), (16, 17, "g\nh")]
    assert len({p.id for p in parts}) == 3
    assert chunking.split_oversized(frame, 8, 1).first().id == "i"
    for bad in ((0, 0), (4, -1), (4, 4)):
        with pytest.raises(ValueError):
            chunking.split_oversized(frame, *bad)


def test_path_filters(spark):
    frame = spark.createDataFrame([(p,) for p in ("src/app.py", "src2/app.py", "tests/test_app.py", "src/test_x.py", "src/gen/a.py")], "filepath string")
    names = lambda f: sorted(r.filepath for r in f.collect())
    assert names(chunking.filter_paths(frame, ("src",), ("src/gen",), True)) == ["src/app.py"]
    assert names(chunking.filter_paths(frame, ("",))) == names(frame)


def bm25_model(docs, query):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    out = {}
    for i, d in docs.items():
        tf = Counter(d)
        out[i] = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query if t in tf)
    return sorted(((round(s, 9), i) for i, s in out.items() if s > 0), key=lambda x: (-x[0], x[1]))


def test_bm25_against_plain_python(spark):
    docs = {0: "alpha beta beta", 1: "beta gamma", 2: "delta", 3: "alpha alpha delta epsilon", 4: "zeta eta", 5: "zeta eta", 6: ""}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    queries = spark.createDataFrame([("a", "alpha beta beta"), ("b", "zeta"), ("c", "unknown"), ("d", " "), ("e", None)], "query_id string, question string")
    found = defaultdict(list)
    for r in sorted(sparse.bm25_topk(sparse.build(frame), queries, 10).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((round(r.score, 9), r.doc_id))
    split = {i: t.split() for i, t in docs.items()}
    assert found["a"] == bm25_model(split, ["alpha", "beta", "beta"]) and [i for _, i in found["b"]] == [4, 5]
    assert set(found) == {"a", "b"}
    assert sparse.bm25_topk(sparse.build(frame), queries, 0).collect() == []


def test_fusion_values_and_order(spark):
    rows = lambda ids: spark.createDataFrame([("q", d, 1.0 - i / 10, i + 1) for i, d in enumerate(ids)], "query_id string, doc_id string, score double, rank int")
    out = fusion.rrf(rows("ab"), rows("bc")).orderBy("rank").collect()
    assert [(r.doc_id, r.rrf_score) for r in out] == [("b", 1 / 62 + 1 / 61), ("a", 1 / 61), ("c", 1 / 62)]
    asked = []
    fusion.hybrid_search(lambda n: asked.append(n) or rows("ab"), lambda n: asked.append(n) or rows("bc"), 2, 3)
    assert asked == [6, 6]
    with pytest.raises(ValueError):
        fusion.hybrid_search(None, None, 0)


def test_neighbours_and_first_seen(spark):
    chunks = spark.createDataFrame([("a", "f", "x", 1, 3), ("b", "f", "x", 3, 5), ("c", "f", "x", 5, 7), ("d", "f", "y", 9, 9)], "id string, filepath string, function_name string, start_line int, end_line int")
    near = {r.id: r.linked for r in fusion.linked_neighbours(chunks, 1).collect()}
    assert near == {"a": ["b"], "b": ["a", "c"], "c": ["b"], "d": []}
    hits = spark.createDataFrame([("q", "b", 1, 0.5), ("q", "a", 2, 0.4)], "query_id string, doc_id string, rank int, score double")
    flat = fusion.flatten_hits(fusion.attach_linked(hits, chunks, 1)).orderBy("position").collect()
    assert [(r.doc_id, r.is_primary) for r in flat] == [("b", True), ("a", False), ("c", False)]
    with pytest.raises(ValueError):
        fusion.linked_neighbours(chunks, -1)


def test_dense_search_blocks_agree(spark):
    rows = spark.createDataFrame([(i, [math.sin(i * k + 1.0) for k in range(1, 6)]) for i in range(60)] + [(60, None)], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    one = sorted(map(tuple, dense.knn_topk(rows, queries, 3).select("query_id", "doc_id", "rank").collect()))
    many = sorted(map(tuple, dense.knn_topk(rows, queries, 3, block=6).select("query_id", "doc_id", "rank").collect()))
    assert one == many and len(one) == 60 and all(q == d for q, d, r in one if r == 1)
    assert dense.knn_topk(rows, queries, 0).collect() == []


def test_dense_search_in_tiles_keeps_ties_by_id(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(dense, "TILE", 7)
    r = np.random.default_rng(3)
    points = dense.units(r.normal(size=(200, 4)))
    points[60:140] = points[5]  # one very common vector
    queries, ids = dense.units(np.concatenate([points[5:6], r.normal(size=(9, 4))])), r.permutation(200)
    for names in (pa.array(ids), pa.array([f"{i:03}" for i in ids])):
        best = dense.Nearest(queries, 6, np.full(10, -np.inf))
        for a, b in ((0, 90), (90, 95), (95, 200)):
            best.add(names[a:b], points[a:b])
        row, found, _ = best.found()
        wanted = [names[int(i)].as_py() for s in queries @ points.T for i in np.lexsort((ids, -np.round(s, 9)))[:6]]
        assert found.to_pylist() == wanted and row.tolist() == [q for q in range(10) for _ in range(6)]


def test_dense_search_tells_scores_apart_that_are_one_in_single_precision(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(dense, "TILE", 20)
    r = np.random.default_rng(5)
    points = dense.units(r.normal(size=(300, 8)))
    points[::3] = dense.units(points[0] + 1e-4 * r.normal(size=(100, 8)))  # scores of these lie within some 1e-7
    points[::50] = np.inf, *[0.0] * 7  # no number when its length is one
    queries, ids = dense.units(np.concatenate([points[[3, 6, 7]], r.normal(size=(9, 8)), points[:1]])), r.permutation(300)
    scores = np.nan_to_num(queries @ dense.units(points).T, nan=-2.0)
    assert len(np.unique(scores[0, 3::3].astype(np.float32))) < len(np.unique(scores[0, 3::3]))
    for k in (1, 6, 299):
        for least in (-np.inf, 0.2):
            best = dense.Nearest(queries, k, np.full(13, least))
            for a, b in ((0, 130), (130, 131), (131, 300)):
                best.add(pa.array(ids[a:b]), points[a:b])
            row, found, score = best.found()
            wanted = [(q, int(ids[i])) for q, s in enumerate(scores) for i in np.lexsort((ids, -np.round(s, 9)))[:k] if s[i] > least]
            assert list(zip(row.tolist(), found.to_pylist(), strict=True)) == wanted
            exact = scores[row, np.argsort(ids)[found.to_numpy()]]
            assert np.allclose(score, np.where(exact < -1.5, np.nan, exact), rtol=0, atol=1e-14, equal_nan=True)


def test_shards_do_not_multiply_with_small_blocks(spark):
    rows = spark.range(400).selectExpr("id AS vec_id", "array(sin(id), cos(id), sin(2 * id)) AS embedding")
    found = dense.knn_topk(rows, rows.withColumnRenamed("vec_id", "query_id"), 3, block=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 133" not in plan and "[0,1,2" not in plan and found.count() == 1200


def test_documents_counted_together_have_the_tokens_of_each(spark):
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from lodestone.functions.text import tokenize

    r = random.Random(8)
    texts = [None, "", "A", "b", "aB", "HTTPServer", "HTTP", "s", "x" * 9, "ÉcoleABc É1Ab", "漢字 getHTTPResponse2XX_y"]
    texts += ["".join(r.choice("aabAB1_ \néK") for _ in range(r.randint(0, 12))) for _ in range(800)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    wanted = [x for (x,) in frame.orderBy("doc_id").select(tokenize(F.col("text"))).collect()]
    dl, counts = sparse.token_counts(pa.array(texts, pa.string()))
    assert dl.tolist() == [len(w) for w in wanted]
    assert [c and [(x["term"], x["tf"]) for x in c] for c in counts.to_pylist()] == [sorted(Counter(w).items()) or None for w in wanted]
    part, _ = sparse.token_counts(pa.array(texts, pa.string()).slice(5, 300))
    assert part.tolist() == dl[5:305].tolist() and sparse.token_counts(pa.array([], pa.string()))[0].tolist() == []
    found = {d: c for d, c in sparse.counted_documents(frame).select("doc_id", "dl").collect()}
    assert found == dict(enumerate(np.asarray(dl).tolist()))
    assert "transform(" not in sparse.counted_documents(frame)._jdf.queryExecution().optimizedPlan().toString()


def test_prompt_budget(spark):
    blocks = spark.createDataFrame([("q", 1, "a" * 10), ("q", 2, "b" * 10), ("q", 3, "c"), ("r", 1, "d" * 50)], "query_id string, position int, block string")
    kept = {(r.query_id, r.position): r.block for r in answering.within_budget(blocks, 30).collect()}
    assert set(kept) == {("q", 1), ("q", 2), ("r", 1)} and kept["r", 1] == "d" * 15 + "\n...[truncated]"


def test_index_and_answers(spark, index, repository):
    path, manifest = index
    engine = Engine(spark, path)
    names = {(c.filepath, c.function_name) for c in engine.chunks.collect()}
    assert ("app.py", "Thing.fetchData") in names and ("README.md", "README:usage") in names and not any(p.startswith(("tests/", "node_modules/")) for p, _ in names)
    assert manifest["chunk_count"] == len(names) and store.load_or_build(spark, repository, path)["built_at"] == manifest["built_at"]
    queries = spark.createDataFrame([("1", "area of a circle"), ("2", "how is area_of_circle handled?"), ("3", "qqqq zzzz")], "query_id string, question string")
    top = {r.query_id: r.doc_id for r in engine.query_bm25(queries, 1).collect()}
    geo = engine.chunks.filter("filepath = 'math/geo.py'").first().id
    assert top == {"1": geo, "2": geo}

    def generator(messages, questions, temperature):
        return [f"It calls `{'area_of_circle' if 'geo' in m else 'nothing_here'}` [1]." for m in messages]

    out = {r.query_id: r for r in engine.answer(queries, generator, retrieval="bm25", k=2, judge=True).collect()}
    assert out["1"].grounded and out["1"].passes == 2 and out["1"].confidence == 1.0 and out["1"].level == "high"
    assert out["3"].answer == REFUSAL_ANSWER and out["3"].passes == 1
    single = {r.query_id: r for r in engine.answer(queries, generator, mode="single", retrieval="hybrid", k=1).collect()}
    assert single["2"].passes == 1 and single["2"].contexts
    with pytest.raises(ValueError):
        engine.answer(queries, generator, mode="other")
    with pytest.raises(FileNotFoundError):
        store.load_sparse(spark, path + "/none")


def test_cache_embeds_only_what_is_new(spark, index):
    path, _ = index
    chunks = spark.read.parquet(f"{path}/chunks")
    cache = spark.read.parquet(f"{path}/embedding_cache")
    both, fresh = dense.embed_missing(chunks, cache, "hashing-64")
    assert fresh.count() == 0 and both.count() == chunks.count()
    assert dense.embed_missing(chunks, cache, "another")[1].count() == chunks.count()


def test_guards_and_confidence(spark):
    cases = [("q", "x [1]", 1, "x [1]"), ("q", " ", 1, REFUSAL_ANSWER), ("q", "x", 1, REFUSAL_ANSWER), ("q", "x [2]", 1, REFUSAL_ANSWER), ("my_fn?", "x [1]", 1, REFUSAL_ANSWER), ("q", "x [1]", 0, REFUSAL_ANSWER)]
    frame = spark.createDataFrame(cases, "question string, answer string, n int, expected string")
    assert frame.filter(answering.guarded(F.col("answer"), F.col("question"), F.col("n")) != F.col("expected")).count() == 0
    samples = spark.createDataFrame([(g, i, a) for g, xs in {"same": ["a b"] * 3, "apart": ["a", "b", "c"], "one": ["a"], "near": ["a b c d", "a b c e", "a b c f"]}.items() for i, a in enumerate(xs)], "query_id string, sample int, answer string")
    pairs = answering.agreement_pairs(samples)
    found = {r.query_id: r for r in answering.confidence(samples, pairs).collect()}
    assert found["same"].confidence == 1.0 and found["same"].level == "high" and not found["same"].should_refuse
    assert found["apart"].confidence == 0.0 and found["apart"].should_refuse and "agree by 0.00" in found["apart"].warning
    assert found["one"].confidence == 0.0 and found["near"].level == "medium" and pairs.filter("query_id = 'apart'").count() == 3


def test_evaluation_and_ablation(spark, tmp_path):
    items = [
        {"id": "1", "question": "what?", "ground_truth_answer": "alpha beta", "ground_truth_context": [{"filepath": "a.py", "function_name": "f"}], "expected_refusal": False},
        {"id": "2", "question": "no?", "ground_truth_answer": "cannot", "ground_truth_context": [], "expected_refusal": True},
    ]
    path = tmp_path / "set.json"
    path.write_text(json.dumps(items))
    frame = read_eval_set(spark, str(path))

    def pipeline(asked):
        ref = F.struct(F.lit("a.py").alias("filepath"), F.lit("f").alias("function_name"))
        return asked.withColumns({"answer": F.when(F.col("question") == "what?", "alpha beta").otherwise(REFUSAL_ANSWER), "contexts": F.array(ref), "grounded": F.lit(True)})

    records, report = evaluation.run_ablation(frame, dict.fromkeys("ABCD", pipeline))
    rows = report.collect()
    assert [r.condition_id for r in rows] == list("ABCD") and records.count() == 8
    assert all((r.context_hit_rate, r.answer_relevance_proxy, r.refusal_accuracy, r.adversarial_refusal_rate, r.adversarial_queries) == (1.0, 1.0, 1.0, 1.0, 4) for r in rows)
    store.write_report(report, str(tmp_path / "report"))
    assert store.read_report(spark, str(tmp_path / "report"))["A"]["context_hit_rate"] == "1.000000"
    judged = evaluation.judge(evaluation.lexical_baselines(records), lambda r: {"answer_correctness": 1.5, "faithfulness": 0.5} if r["id"] == "1" else 1 / 0)
    means = evaluation.judge_summary(judged, "condition_id").first()
    assert (means.answer_correctness, means.faithfulness, means.rouge1_f1, means.rougeL_f1, means.bleu, means.errors) == (1.0, 0.5, 1.0, 1.0, 1.0, 1)
    with pytest.raises(ValueError):
        evaluation.score_items(frame, pipeline(frame.limit(1).select(F.col("id"), "question")))
    path.write_text(json.dumps([{**items[0], "question": " "}]))
    with pytest.raises(ValueError):
        read_eval_set(spark, str(path))
    assert evaluation.external_scores(records, None)["enabled"] is False


def test_logs_and_streams(spark, tmp_path):
    from lodestone.streaming.refresh import log_stream

    rows = spark.createDataFrame([("1", "a", True), ("2", None, False)], "query_id string, answer string, grounded boolean")
    store.append_jsonl(rows, str(tmp_path / "log"))
    store.append_jsonl(rows, str(tmp_path / "log"))
    store.append_jsonl(rows, "none")
    query = log_stream(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("logged").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("logged").count() == 4


def test_clone_refuses_foreign_folders(tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/file").write_text("")
    with pytest.raises(FileExistsError):
        clone("https://example.invalid/x.git", str(tmp_path / "x"))
    (tmp_path / "y/.git").mkdir(parents=True)
    assert clone("https://example.invalid/y.git", str(tmp_path / "y")) == str(tmp_path / "y")
