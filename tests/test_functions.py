import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as X


def values(spark, rows, *columns):
    names = [f"c{i}" for i in range(len(rows[0]))]
    schema = ", ".join(f"{n} string" for n in names)
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(*columns).collect()]


def test_tokenizer_cases(spark):
    cases = {
        "processPayment": ["process", "payment"], "get_user_by_id": ["get", "user", "by", "id"], "HTTPSConnection": ["https", "connection"],
        "HTTPRequestParser": ["http", "request", "parser"], "version2": ["version2"], "": [], "a-b c.d": ["a", "b", "c", "d"], "É x": ["x"],
    }
    found = values(spark, [(k,) for k in cases], X.tokenize(F.col("c0")))
    assert [x for (x,) in found] == list(cases.values())


def test_question_tokens(spark):
    asked = [("How is the error handled?",), ("where is the",), ("",), (None,)]
    found = [x for (x,) in values(spark, asked, X.query_tokens(F.col("c0")))]
    assert found == [["error", "handled", "handle", "handler"], ["where", "is", "the"], [], []]


def test_ids_slugs_and_limits(spark):
    row = values(spark, [("sample.py", "top_level", "4", "7")], X.chunk_id(*map(F.col, ("c0", "c1", "c2", "c3"))))
    assert row == [("d716831635f5b39f",)]
    slugs = values(spark, [("Project Title!",), ("--",), ("x" * 80,)], X.slug(F.col("c0")))
    assert slugs == [("project-title",), ("",), ("x" * 60,)]
    short = values(spark, [("short",), ("a long   text that goes on",)], X.limit_text(F.col("c0"), 20), X.limit_text(F.col("c0"), 5), X.limit_text(F.col("c0"), None))
    assert short[0] == ("short", "short", "short")
    assert short[1] == ("a lon\n...[truncated]"[:20], "a lon", "a long   text that goes on")
    names = values(spark, [("https://host/team/engine.git",), ("git@host:team/engine",), ("https://host/engine/",)], X.repo_name(F.col("c0")))
    assert [n for (n,) in names] == ["engine"] * 3


def test_similarity(spark):
    pairs = [("", ""), ("a", ""), ("A b", "b c"), (None, None)]
    assert [x for (x,) in values(spark, pairs, X.jaccard(F.col("c0"), F.col("c1")))] == [1.0, 0.0, 1 / 3, 1.0]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b"))).collect()
    assert abs(v[0][0] - math.sqrt(0.5)) < 1e-12 and v[1][0] == 0.0
    clamped = values(spark, [("2",), ("-1",), ("nan",), ("x",), ("0.5",)], X.clamp(F.col("c0")))
    assert [x for (x,) in clamped] == [1.0, 0.0, None, None, 0.5]


def test_guards(spark):
    answers = [("see [1]",), ("see [999]",), ("see [0]",), ("none",), ("",), ("[1] and [2]",)]
    assert [x for (x,) in values(spark, answers, X.invalid_citations(F.col("c0"), F.lit(2)))] == [False, True, True, True, True, False]
    rows = [("What does get_user do with fooBar?", "GET_USER calls foobar"), ("What does get_user do?", "it returns"), ("plain words", "x")]
    assert [x for (x,) in values(spark, rows, X.missing_identifiers(F.col("c0"), F.col("c1")))] == [[], ["get_user"], []]
    marks = [("I cannot find this.",), ("It CAN'T FIND it",), ("fine",), (None,)]
    assert [x for (x,) in values(spark, marks, X.is_refusal(F.col("c0")))] == [True, True, False, False]


def test_claims(spark):
    answer = "Call `load it` then run_all(x), someThing and HttpClient; also `ab` and Normal words."
    rows = values(spark, [(answer, "run_all someThing"), (answer, None), ("no code", "x")], X.claims(F.col("c0")), X.ungrounded_claims(F.col("c0"), F.col("c1")))
    assert rows[0] == (["HttpClient", "load it", "run_all", "someThing"], ["HttpClient", "load it"])
    assert rows[1][1] == [] and rows[2] == ([], [])


def toks(text):
    return re.findall(r"[a-z_][a-z0-9_]*", (text or "").lower())


def test_metrics_against_plain_python(spark):
    r = random.Random(3)
    text = lambda: " ".join(r.choice("a b c d e f_1 g").strip() for _ in range(r.randint(0, 25)))
    rows = [(text(), text()) for _ in range(60)] + [(None, "a"), ("a", ""), ("", "")]
    cols = [f(F.col("c0"), F.col("c1")) for f in (M.token_overlap, M.rouge1, M.bleu1, M.rouge_l)]
    for (a, b), found in zip(rows, values(spark, rows, *cols), strict=True):
        x, y = toks(a), toks(b)
        common = sum((Counter(x) & Counter(y)).values())
        dp = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                dp[i + 1][j + 1] = dp[i][j] + 1 if p == q else max(dp[i][j + 1], dp[i + 1][j])
        f1 = lambda n: 2 * n / (len(x) + len(y)) if n else 0.0
        bleu = common / len(x) * (1 if len(x) > len(y) else math.exp(1 - len(y) / len(x))) if x and y else 0.0
        overlap = len(set(x) & set(y)) / len(set(y)) if y else 0.0
        for got, want in zip(found, (overlap, f1(common), bleu, f1(dp[-1][-1])), strict=True):
            assert abs(got - want) < 1e-9


def test_context_metrics(spark):
    frame = spark.sql(
        "SELECT array(struct('a' AS filepath, 'f' AS function_name), struct('b' AS filepath, CAST(NULL AS STRING) AS function_name)) AS e, "
        "array(struct('a' AS filepath, 'g' AS function_name), struct('b' AS filepath, 'x' AS function_name), struct('b' AS filepath, 'y' AS function_name)) AS a"
    )
    e, a = F.col("e"), F.col("a")
    row = frame.select(M.context_hit(e, a), M.context_recall(e, a), M.context_precision(e, a), F.size(M.missing(e, a))).first()
    assert tuple(row) == (1.0, 0.5, 2 / 3, 1)


def test_fixed_places_are_those_of_printf(spark):
    r = random.Random(5)
    numbers = [0.125, 0.375, 0.075, 0.145, 0.285, 0.995, 0.005, 1.005, 2.5e-7, 0.9999995, -0.125, -0.0, -1e-9, 0.0, 123456.0000005, 4503599627370496.5, 8.5]
    numbers += [i / 1000 for i in range(5, 1000, 10)] + [r.uniform(-1000, 1000) for _ in range(500)] + [r.randrange(10**7) / 10**7 for _ in range(500)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    for places in (2, 3, 6):
        found = [t for (t,) in frame.orderBy("i").select(X.fixed(F.col("x"), places)).collect()]
        assert found == [f"{x:.{places}f}" for x in numbers]
    assert spark.range(1).select(X.fixed(F.lit(None).cast("double"), 2)).first()[0] is None


def test_measures_work_out_their_arguments_once(spark):
    from lodestone.operators import answering

    samples = spark.createDataFrame([("q", 0, "a b"), ("q", 1, "b c")], "query_id string, sample int, answer string")
    marked = lambda t: F.array(F.length(F.concat(t, F.lit("MARK"))).cast("double"), F.lit(1.0))
    pairs = answering.agreement_pairs(samples, semantic=X.cosine, features=marked)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MARK") == 1 and plan.count("array_intersect") == 1
    assert pairs.select("lexical", "semantic", "combined").first() == (round(1 / 3, 6), 1.0, round(0.4 / 3 + 0.6, 6))
