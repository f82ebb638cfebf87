import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from lodestone.llm import packing, quality
from lodestone.llm.bpe import codec
from lodestone.llm.queries import ORACLE_SQL, QUERIES, vocabulary

from .conftest import SCHEMA, prose
from .test_search import brute_classes, edited
from .test_text_rules import base_counts, check_packed


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_take_effect(spark, tmp_path):
    base, passage = prose(1, 200), prose(2, 80)
    rows = [(0, base), (1, base), (2, edited(base, 0.01, 1)), (3, "too short"), (4, None), (5, "a b c " * 60)]
    rows += [(10, passage + " " + prose(10, 60)), (11, prose(11, 60) + " " + passage), (20, prose(20, 100)), (21, prose(21, 9000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {}
    for r in out:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
    assert set(sizes) == {0, 10, 11, 20, 21}
    tokens = lambda text: codec(*vocabulary("byte_bpe_50k.json"), added=True).count(text) + 1
    texts = {i: t for i, t in rows if t}
    assert all(sizes[i] == tokens(texts[i]) for i in (0, 20, 21))
    kept, cut = max(sizes[10], sizes[11]), min(sizes[10], sizes[11])
    assert kept in (tokens(texts[10]), tokens(texts[11])) and cut < kept - 60


def plain_pipeline(rows):
    """The stages in plain Python, up to the texts that are packed: texts by id, and the passages of
    which one holder keeps its own."""
    by_host = defaultdict(set)
    for _, text, host in rows:
        by_host[host].add(text or "")
    normal = lambda line: re.sub(r"[\x00-\x60\x7B-\x7F]+", " ", line.lower()).strip(" ")
    frequent = set()
    for host, texts in by_host.items():
        counts = Counter(x for t in texts for x in {normal(line) for line in t.split("\n")} - {""})
        frequent |= {(host, x) for x, n in counts.items() if n > quality.MIN_DOCS and n > min(quality.MAX_SHARE * len(texts), quality.MAX_DOCS)}
    stage1 = {}
    for i, text, host in rows:
        n, *_, repeated = base_counts(text)
        if n < 50 or 100 * repeated > 50 * n:
            continue
        lines = [x for x in text.split("\n")]
        left = [x for x in lines if (host, normal(x)) not in frequent]
        all_words, left_words = (sum(len(x.split()) for x in xs if normal(x)) for xs in (lines, left))
        if left_words >= quality.MIN_LEFT * all_words:
            stage1[i] = "\n".join(left) if len(left) < len(lines) else text
    groups = brute_classes(list(stage1.items()), 5, 80)
    stage2 = {i: t for i, t in stage1.items() if groups[i][1] == i}
    holders = defaultdict(set)
    for i, text in stage2.items():
        w = text.split()
        for a in range(len(w) - 44):
            holders[tuple(w[a : a + 45])].add(i)
    shared = {run: ids for run, ids in holders.items() if len(ids) > 1}
    return stage2, shared


def test_run_against_a_plain_version(spark, tmp_path):
    r = random.Random(12)
    footer = "Read more on our page, 12 readers liked this."
    passages = [prose(900 + k, 60 + 10 * k) for k in range(3)]
    rows = []
    for i in range(60):
        text = prose(1000 + i, r.randint(60, 160))
        if i < 15:
            text += "\n" + footer
        if i in (5, 20, 33, 47):
            text = text + " " + passages[i % 3] + " " + prose(2000 + i, 30)
        rows.append((i, text, f"h{i % 2 if i >= 15 else 0}"))
    rows += [(100 + i, rows[30 + i][1], "h0") for i in range(5)]  # copies
    one_other = lambda text: " ".join(["other" if k == 30 else w for k, w in enumerate(text.split())])
    rows += [(110 + i, one_other(rows[40 + i][1]), "h1") for i in range(5)]  # near copies
    rows += [(120, "too short", "h0"), (121, None, "h0"), (122, "a b c " * 60, "h1"), (123, (footer + "\n") * 9, "h0"), (124, passages[0] + " " + prose(3000, 40), "h1")]
    spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, t, h in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected, shared = plain_pipeline(rows)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        seen.append({x.doc_id: x.text for x in docs.collect()})
    assert seen[1] == expected
    # each shared passage stays whole in one of its holders; words that none shares stay everywhere
    assert set(seen[2]) == set(expected)
    for run, ids in shared.items():
        assert sum(" ".join(run) in " ".join(seen[2][i].split()) for i in ids) == 1
    loose = lambda i: {w for a, w in enumerate(expected[i].split())} - {w for run, ids in shared.items() if i in ids for w in run}
    assert all(loose(i) <= set(seen[2][i].split()) for i in expected)
    assert all(seen[2][i] == t for i, t in expected.items() if not any(i in ids for ids in shared.values()))
    count = codec(*vocabulary("byte_bpe_50k.json"), added=True).count
    lengths = {i: count(t) + 1 for i, t in seen[2].items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packed(out, lengths, packing.CAPACITIES)
    assert {x.doc_id for x in out} == set(lengths)


def test_stages_of_edges(spark, edges, nothing, data):
    for docs in (edges, nothing):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == columns, name
            assert out.count() <= docs.count()
            extra = [c for c in columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
            assert all(r[c] == 1 for r in out.collect() for c in extra)
        corpus_pipeline.STAGES[-1][1](spark, docs, data).count()
