import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import importance
from lodestone.llm.queries import ORACLE_SQL, QUERIES

from .conftest import SCHEMA, prose


def plain(docs, target, percent=5, least=20, buckets=10_000):
    """key, n_features, weight, score of each document, and the keys drawn, one feature after another."""
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    found = [(key, *features(text)) for key, text in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for text in target for b in features(text)[1])
    raw, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1.0) * (raw + buckets)) / ((s[b] + 1.0) * (wanted + buckets)))) for b in s}
    out = []
    for key, words, f in found:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((key, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    drawn = Counter((x[0], x[4], i) for i, x in enumerate(able[: math.floor(percent * len(able) / 100)], 1))
    return out, drawn


def check(rows, docs, target, **options):
    expected, drawn = plain(docs, target, **options)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in rows) == Counter((k, n, w, s) for k, _, n, w, s in expected)
    assert Counter((r.doc_id, r.score, r["rank"]) for r in rows if r["rank"]) == drawn


def texts(n):
    r = random.Random(7)
    words = ["Alpha", "beta", "Γάμμα", "DELTA", "e1", "ß", "漢字", "zeta"]
    return [(i, r.choice([" ", "", "-"]) + r.choice([" ", ", ", "\n"]).join(r.choice(words) + str(r.randint(0, 9)) for _ in range(r.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("percent, least", [(5, 20), (100, 1), (33, 0)])
def test_weights_and_draws_against_plain_python(spark, percent, least):
    docs = texts(300)
    target = [t for _, t in docs[::9]] + ["of its own words", None, ""]
    found = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, least_words=least, part_bytes=4096)
    check(found.collect(), docs, target, percent=percent, least=least)


def test_edges(spark, edges, nothing):
    """Repeated rows and keys compete row by row; texts without words have no features; clashing columns are not read."""
    docs, target = [(r.doc_id, r.text) for r in edges.collect()], [prose(3, 60)]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, row int")
    rows = importance.resample(edges.withColumns({c: F.lit(1) for c in ("row", "at", "bucket", "gain", "weight", "score", "rank", "w1", "b1")}), aim, percent=60).collect()
    check(rows, docs, target, percent=60)
    assert {(r.n_features, r.weight, r["rank"]) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 0, None)}
    assert importance.resample(nothing, aim).collect() == []
    check(importance.resample(edges, nothing, percent=60).collect(), docs, [], percent=60)


def test_ties_go_to_the_smaller_key(spark):
    """Rows with one key have one score; half of them is drawn, each with a rank of its own."""
    rows = [(7, "one two " * 15)] * 6 + [(8, "one two " * 15)] * 4
    found = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("one",)], "text string"), percent=50).collect()
    check(found, rows, ["one"], percent=50)
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3, 4, 5]


def test_results_do_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame([(*x, "en", "s", 0) for x in texts(80)], SCHEMA)
    aim = docs.limit(5)
    rows = [{tuple(r) for r in importance.resample(docs.repartition(n), aim, part_bytes=b, percent=40).collect()} for n, b in ((1, 1 << 20), (7, 2048))]
    assert rows[0] == rows[1]


def test_sql_agrees_over_the_table(spark, data):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    found = QUERIES["op13_importance_resampling"](spark, data)
    cursor = con.execute(ORACLE_SQL["op13_importance_resampling"])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert set(cursor.fetchall()) == {tuple(r[n] for n in names) for r in found.collect()}
