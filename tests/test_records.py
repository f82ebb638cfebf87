import json
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import answering, clients, dense, evaluation, records
from lodestone.plans import store
from lodestone.plans.records_catalog import RULES, _items, ablation_report


def test_chat_client_speaks_the_usual_form():
    seen = []

    def send(request, timeout):
        seen.append((request.full_url, json.loads(request.data), dict(request.header_items()), timeout))
        return json.dumps({"choices": [{"message": {"content": "fine [1]"}}]}).encode()

    client = clients.ChatClient("http://host/v1/", "small", "key", 5, send)
    assert client(["a", "b"], ["qa", "qb"], 0.5, system="be strict") == ["fine [1]"] * 2
    url, body, headers, timeout = seen[0]
    assert url == "http://host/v1/chat/completions" and timeout == 5 and headers["Authorization"] == "Bearer key"
    assert body["messages"] == [{"role": "system", "content": "be strict"}, {"role": "user", "content": "a"}] and body["temperature"] == 0.5
    assert answering.takes_system(client) and not answering.takes_system(lambda m, q, t: m)
    with pytest.raises((urllib.error.URLError, OSError)):
        clients.ChatClient("http://127.0.0.1:9/v1", "small", timeout=1, tries=1)(["a"], ["q"])


def test_requests_are_sent_again_and_a_few_at_once():
    import threading
    import time
    from urllib.error import HTTPError

    seen, lock, now, most = [], threading.Lock(), 0, 0

    def send(request, timeout):
        nonlocal now, most
        text = json.loads(request.data)["messages"][-1]["content"]
        with lock:
            seen.append(text)
            now, most = now + 1, max(most, now + 1)
            n = seen.count(text)
        time.sleep(0.01)
        with lock:
            now -= 1
        if text == "busy" and n < 3:
            raise HTTPError(request.full_url, 429, "later", {}, None)
        if text == "lost" and n < 2:
            raise ConnectionResetError
        if text == "wrong":
            raise HTTPError(request.full_url, 400, "bad", {}, None)
        return json.dumps({"choices": [{"message": {"content": f"to {text}"}}]}).encode()

    client = clients.ChatClient("http://host/v1", "small", send=send, at_once=3, pause=0.001)
    texts = ["a", "busy", "b", "lost", *map(str, range(12))]
    assert client(texts, texts) == [f"to {t}" for t in texts]
    assert seen.count("busy") == 3 and seen.count("lost") == 2 and 1 < most <= 3
    with pytest.raises(HTTPError):
        client(["wrong"], ["q"])
    assert seen.count("wrong") == 1
    with pytest.raises(HTTPError):
        clients.ChatClient("http://host/v1", "small", send=send, tries=2, pause=0.001)(["busy2", "wrong"], ["q", "q"])


def test_system_prompt_reaches_every_generator(spark):
    asked = spark.createDataFrame([("1", "q", "[1] ctx", 1), ("2", "q", None, 0)], "query_id string, question string, context string, n_chunks int")
    plain = answering.generate(asked, lambda messages, questions, t: [f"{'snippets' in m} {m.startswith('You')} [1]" for m in messages])
    apart = answering.generate(asked, lambda messages, questions, t, system: [f"{system.startswith('You')} {m.startswith('Question')} [1]" for m in messages])
    for out in (plain, apart):
        assert {r.query_id: r.answer for r in out.collect()} == {"1": "True True [1]", "2": answering.REFUSAL_ANSWER}


def test_models_are_called_once(spark, tmp_path):
    """What answers depend on is read from files: a second reading asks no model."""
    calls = str(tmp_path / "calls")

    def generator(messages, questions, temperature):
        with open(calls, "a") as out:
            out.write("x" * len(messages))
        return ["as shown [1]"] * len(messages)

    asked = spark.createDataFrame([("1", "what?", "[1] ctx", 1)], "query_id string, question string, context string, n_chunks int")
    samples = answering.sampled(asked, generator, (0.0, 0.5))
    assert samples.count() == samples.count() == 2 and len(open(calls).read()) == 2


def test_pooling_and_similarity(spark):
    states = np.array([[[1.0, 0.0], [3.0, 4.0]], [[0.0, 2.0], [9.0, 9.0]]])
    pooled = clients.mean_pooled(states, np.array([[1, 1], [1, 0]]))
    assert np.allclose(pooled, [[2 / np.sqrt(8), 2 / np.sqrt(8)], [0, 1]])

    def load(name):
        return (lambda texts: {"texts": texts, "attention_mask": [[1, 1]] * len(texts)}), (lambda fed: [[[len(t), 1.0], [0.0, 1.0]] for t in fed["texts"]])

    embedder = clients.TransformerEmbedder("tiny", load=load)
    assert np.allclose(embedder(["ab"]), [[1 / np.sqrt(2), 1 / np.sqrt(2)]])
    with pytest.raises(RuntimeError):
        clients.TransformerEmbedder("none")(["a"])
    pairs = spark.createDataFrame([("same words", "same words", 1.0), ("one", "", 0.0)], "a string, b string, expected double")
    similar = clients.semantic_by(dense.hashing_embedder())
    assert pairs.filter(F.abs(similar(F.col("a"), F.col("b")) - F.col("expected")) > 1e-9).count() == 0
    samples = spark.createDataFrame([("1", i, a) for i, a in enumerate(["x y", "y x"])], "query_id string, sample int, answer string")
    found = answering.agreement_pairs(samples, semantic=similar).first()
    assert found.combined == pytest.approx(1.0) and found.semantic == pytest.approx(1.0)


def test_fixture_and_records(spark):
    chunks = records.fixture_chunks(spark)
    assert chunks.count() == 2
    rows = spark.createDataFrame([('{"chunk_id": "a", "text": "t", "start_line": 2.5}',), ("[1]",), (None,)], "payload string")
    found = [r.chunk for r in records.normalise_chunks(rows).collect()]
    assert (found[0].id, found[0].source, found[0].start_line, found[0].filepath) == ("a", "t", 2, "") or found[0].start_line == 0
    assert found[1:] == [None, None]
    assert evaluation.report_fields(spark.createDataFrame([(1, 2)], "zeta int, alpha int"))[-2:] == ["alpha", "zeta"]


def test_run_and_confidence_records(spark):
    answers = spark.createDataFrame([("1", "q", "a [1]", "iterative", "p")], "query_id string, question string, answer string, mode string, partial_answer string")
    chunk = "array<struct<id:string,filepath:string,function_name:string,start_line:int,end_line:int,source:string>>"
    passes = spark.createDataFrame([("1", 1, "q", [("c", "f", "g", 1, 2, "s")], 1.5, 2.5), ("1", 2, "q p", [], 0.5, 0.25)], f"query_id string, pass int, query string, chunks {chunk}, retrieval_ms double, generation_ms double")
    r = store.run_records(answers, passes, 7, F.lit(3.25)).first()
    assert (r.mode, r.top_k, r.pass_1.query, r.pass_2.query, r.latency_ms) == ("iterative", 7, "q", "q p", 3.25)
    assert r.pass_1.retrieved_chunks[0].asDict() == {"id": "c", "filepath": "f", "function_name": "g", "start_line": 1, "end_line": 2} and r.pass_2.generation_ms == 0.25
    samples = spark.createDataFrame([("1", i, a) for i, a in enumerate(["x", "x", "y"])], "query_id string, sample int, answer string")
    pairs = answering.agreement_pairs(samples)
    log = store.confidence_records(answering.confidence(samples, pairs), samples, pairs, 0.72, (0.0, 0.5, 0.9)).first()
    assert log.raw_answers == ["x", "x", "y"] and len(log.pair_scores) == 3 and log.temperatures == [0.0, 0.5, 0.9] and log.should_refuse
    assert store.elapsed_ms(0) > 0


def test_ablation_documents_of_one_file(spark, tmp_path):
    document = {"conditions": [{"condition": {"id": "A"}, "metrics": {"records": [{"id": "1", "answer": "x"}, {"id": "9", "answer": "y"}]}}, {"condition": {"id": "B"}, "metrics": {"records": [{"id": "2", "answer": None}]}}]}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=1))
    items = spark.createDataFrame([("1", "q1", "t1", False), ("2", "q2", "t2", True)], "id string, question string, ground_truth_answer string, expected_refusal boolean")
    found = sorted((r.condition_id, r.id, r.question, r.answer, r.expected_refusal) for r in store.read_ablation(spark, str(tmp_path / "a.json"), items).collect())
    assert found == [("A", "1", "q1", "x", False), ("B", "2", "q2", "", True)]
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        store.read_ablation(spark, str(tmp_path / "b.json"), items)


def test_ablation_report_against_plain_python(spark, data):
    items = [r.asDict(True) for r in _items(spark, data).collect()]
    report = {r.condition_id: r for r in ablation_report(spark, data).collect()}
    probes = {i["question"] for i in items if i["expected_refusal"]} | set(evaluation.ADVERSARIAL_QUERIES)
    for condition in evaluation.CONDITIONS:
        n = RULES[condition.id]
        at = {i["id"]: (3 * len(i["question"]) + int(i["id"])) % n for i in items}
        refused = {k: v == 0 for k, v in at.items()}
        asked = [i for i in items if not i["expected_refusal"]]
        hit = [f"f{int(i['id']) % 7}" == i["ground_truth_context"][0]["filepath"] for i in asked]
        row = report[condition.id]
        mean = lambda xs: round(sum(xs) / len(xs), 6) if xs else None
        assert row.total_questions == len(items) and row.answerable_questions == len(asked) and row.adversarial_queries == len(probes)
        assert row.context_hit_rate == mean(hit) and row.refusal_accuracy == mean([refused[i["id"]] for i in items if i["expected_refusal"]])
        assert row.avg_confidence == mean([v / n for v in at.values()]) and row.low_confidence_rate == mean([v < 2 for v in at.values()])
        assert row.external_length == mean([len(answering.REFUSAL_ANSWER) if refused[i["id"]] else len("truth [1]") for i in items])


def test_conditions_in_one_plan_equal_a_pipeline_each(spark, tmp_path):
    """Shared retrieval and first passes change no answer, and a question is retrieved once for each kind and pass."""
    from pyspark.sql import functions as F

    from lodestone.plans.search import Engine

    chunks = spark.createDataFrame(
        [(f"c{i}", f"f{i % 9}.py", f"name_{i}", i, i + 2, "", f"def name_{i}(): return 'word{i} other{i % 7}'", "python") for i in range(40)],
        "id string, filepath string, function_name string, start_line int, end_line int, docstring string, source string, language string",
    )
    store.write_index(chunks, str(tmp_path / "index"))
    engine = Engine(spark, str(tmp_path / "index"))
    rows = [(str(i), f"where is word{i} or name_{i}?", f"name_{i} returns word{i}", [(f"f{i % 9}.py", f"name_{i}")], i % 4 == 0) for i in range(8)]
    items = spark.createDataFrame(rows, "id string, question string, ground_truth_answer string, ground_truth_context array<struct<filepath string, function_name string>>, expected_refusal boolean")
    calls = spark.sparkContext.accumulator(0)

    def generator(messages, questions, temperature=0.0, system=""):
        calls.add(len(messages))
        return [f"name_{q.split('name_')[1].split('?')[0]} [1]" if "name_" in q and int(q.split("word")[1][0]) % 3 else "" for q in questions]

    one_records, one = evaluation.run_conditions(items, lambda q: engine.answer_conditions(q, generator, 3, judge=True))
    one = one.collect()
    shared, calls.value = calls.value, 0
    pipelines = {c.id: lambda q, c=c: engine.answer(q, generator, c.mode, c.retrieval, 3, judge=True) for c in evaluation.CONDITIONS}
    each_records, each = evaluation.run_ablation(items, pipelines)
    assert one == each.collect() and len(one) == 4
    assert calls.value > 1.5 * shared
    key = ["condition_id", "id", "answer", "mode", "passes", "confidence", "context_recall"]
    assert sorted(map(str, one_records.select(key).collect())) == sorted(map(str, each_records.select(key).collect()))
    with pytest.raises(ValueError):
        evaluation.run_conditions(items, lambda q: engine.answer_conditions(q, generator, 3).filter(F.col("condition_id") != "B"))


def test_commands(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "geo.py").write_text("def area_of_circle(radius):\n    return 3 * radius * radius\n")
    (repo / "text.py").write_text("def upper(word):\n    return word.upper()\n")
    for n in range(4):
        (repo / f"pad{n}.py").write_text(f"def pad_{n}(x):\n    return x + {n}\n")
    index, tests, out = str(tmp_path / "index"), str(tmp_path / "set.json"), str(tmp_path / "ablation")
    ref = [{"filepath": "geo.py", "function_name": "area_of_circle"}]
    (tmp_path / "set.json").write_text(json.dumps([
        {"id": "1", "question": "what is the area of a circle?", "ground_truth_answer": "three times the radius squared", "ground_truth_context": ref, "expected_refusal": False},
        {"id": "2", "question": "who paid?", "ground_truth_answer": "unknown", "ground_truth_context": [], "expected_refusal": True},
    ]))

    def client(messages, questions, temperature=0.0, system=""):
        return [json.dumps({"answer_correctness": 1, "faithfulness": 0.5, "refusal_quality": 0}) if "JSON" in m else "three times the radius squared [1]" for m in messages]

    def run(*args):
        assert cli.main(list(args), client=client) == 0
        return capsys.readouterr().out.strip().splitlines()

    assert json.loads(run("ingest", str(repo))[-1])["files"] == 6
    assert any("area_of_circle" in line for line in run("chunk", str(repo)))
    assert json.loads(run("build", str(repo), "--out", index)[-1])["chunk_count"] == 6
    assert json.loads(run("search", index, "area of circle", "--retrieval", "bm25", "--top-k", "1")[0])["filepath"] == "geo.py"
    for kind in ("dense", "sparse"):
        lines = [json.loads(x) for x in run(kind, str(repo), "--out", index, "--query", "area of circle", "--top-k", "2")]
        assert lines[0] == {"chunks": 6, "rebuilt": True} and lines[1]["filepath"] == "geo.py" and lines[1]["rank"] == 1 and len(lines) <= 3
        assert json.loads(run(kind, str(repo), "--out", index)[0])["rebuilt"] is False
        assert json.loads(run(kind, str(repo), "--out", index, "--force-rebuild")[0])["rebuilt"] is True
    assert run("generate", "what is three times the radius?")[0].startswith("three times the radius")
    assert json.loads(run("answer", index, "area of circle", "--retrieval", "bm25", "--log", str(tmp_path / "log"))[0])["answer"].startswith("three")
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    scored = json.loads(run("evaluate", index, tests, "--oracle")[0])
    assert scored["context_recall"] == 1.0 and scored["refusal_accuracy"] == 1.0
    assert json.loads(run("evaluate", index, tests, "--retrieval", "bm25", "--mode", "single")[0])["context_hit_rate"] == 1.0
    lines = run("ablation", index, tests, "--out", out)
    assert len(lines) == 4 and lines[1].startswith("B Hybrid") and "context hits 1.000" in lines[1]
    judged = [json.loads(x) for x in run("judge", out, tests, "--out", str(tmp_path / "judged"))]
    assert [j["condition_id"] for j in judged] == list("ABCD") and all(j["answer_correctness"] == 1.0 and j["errors"] == 0 for j in judged)
