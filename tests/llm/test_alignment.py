import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment
from lodestone.llm.bpe import byte_alphabet
from lodestone.llm.queries import QUERIES, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")[0]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A[0]), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def plain_tokens(text, libraries):
    """Ids and bytes of both tokenizers' tokens; None for a text without tokens."""
    if not text:
        return None
    a, b = libraries
    value = {c: i for i, c in enumerate(byte_alphabet())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
    raw = (" " + text).encode()
    return (ids_a, raw_a, ids_b, raw_b) if b"".join(raw_a) == raw == b"".join(raw_b) else None


def plain(rows, libraries):
    """Every row's result, token by token."""
    docs, holders = [], Counter()
    for key, text in rows:
        found = plain_tokens(text, libraries)
        if found is None:
            docs.append((key, None))
            continue
        ids_a, raw_a, ids_b, raw_b = found
        spans = []
        for raw in (raw_a, raw_b):
            at, own = 0, []
            for t in raw:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            side = [",".join(str(i) for i, (_, e) in zip(ids, own, strict=True) if low < e <= cut) for ids, own in zip((ids_a, ids_b), spans, strict=True)]
            groups.append("|".join(side))
            low = cut
        links = [(x, y) for x, (s, e) in zip(ids_a, spans[0], strict=True) for y, (u, v) in zip(ids_b, spans[1], strict=True) if s < v and u < e]
        holders.update(set(links))
        docs.append((key, (len(ids_a), len(ids_b), groups, links)))
    top = {}
    for (x, _), n in holders.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for key, found in docs:
        if found is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            best = sum(holders[p] == top[p[0]] for p in links)
            out.append((key, n_a, n_b, len(groups), len(links), best, sum(holders[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, holders, top


def strange(n: int) -> list[str]:
    r = random.Random(9)
    letters = [*"ab Ab .,'stll\n\r\t\x1c\x85\xa0é́漢字🙂​12_-", "  ", "   ", " the ", " un", "ing ", "</s>", "<s>", "<unk>", "<|endoftext|>", "▁", "<0x41>", "\x00"]
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(n)]


def order(rows):
    return sorted(rows, key=lambda x: (x[0] is None, *map(str, x)))


def test_parts_of_strange_texts_agree_with_whole_texts(libraries):
    """The groups of parts, put together, are those of the libraries' tokens of the whole text."""
    own = alignment.Aligner(*A, B)
    r = random.Random(4)
    solid = ["".join(r.choice([*"aAb.,'é漢🙂12_-&", "ing", "un", "</s>"]) for _ in range(r.randint(1, 12))) for _ in range(400)]
    lines = ["".join(r.choice(solid) + r.choice([" ", " ", "\n"]) for _ in range(12)).strip() for _ in range(300)]
    texts = [*strange(1500), "x▁y", "no break" + "漢" * 300, *lines, "\nbegins with a line end\nand goes on", " \nx"]
    expected, *_ = plain(list(enumerate(texts)), libraries)
    for at in range(0, len(texts), 50):
        for found, wanted in zip(own.texts(texts[at : at + 50]), expected[at : at + 50], strict=True):
            assert (*found[:4], found[4]) == (*wanted[1:5], wanted[7]), texts[wanted[0]]
    assert sum(x[1] == 0 for x in expected) > 10  # those with U+2581


def test_known_parts_move_on_between_generations(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_PARTS", 30)
    own = alignment.Aligner(*A, B)
    r = random.Random(2)
    texts = [" ".join(r.choice(["alpha", "beta,", "gamma-ray", "unbelievable", f"w{r.randint(0, 400)}"]) for _ in range(8)) for _ in range(300)]
    expected, *_ = plain(list(enumerate(texts)), libraries)
    found = [x for at in range(0, 300, 7) for x in own.texts(texts[at : at + 7])]
    assert [(*x[:4], x[4]) for x in found] == [(*w[1:5], w[7]) for w in expected]
    assert own.older.groups and "alpha" in own.known.at


@pytest.mark.parametrize("few_pairs", [alignment.FEW_PAIRS, 0])
def test_both_ways_against_brute_force(spark, edges, libraries, few_pairs, monkeypatch):
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 5000 else r.text[:5000]) for r in edges.collect()] + list(enumerate(strange(60), 100)) + [(200, "same text")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found, pairs = alignment.align(docs, *A, B, few_pairs=few_pairs)
    expected, holders, top = plain(rows, libraries)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found.columns == columns
    assert order(map(tuple, found.collect())) == order(expected)
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in holders.items()}


def test_whole_edges_and_empty_table(edges, nothing, libraries):
    found, _ = alignment.align(edges, *A, B)
    expected, *_ = plain([(r.doc_id, r.text) for r in edges.collect() if not r.text or len(r.text) < 20_000], libraries)
    own = {x[7] for x in expected}
    assert found.count() == edges.count() and len([r for r in found.collect() if r.groups_sha256 not in own]) == 1  # the long text
    found, pairs = alignment.align(nothing, *A, B)
    assert found.collect() == [] and pairs.collect() == []


def test_tasks_hand_on_what_they_hold(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 10)
    rows = list(enumerate(strange(80)))
    docs = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string"), *A, B)
    _, holders, _ = plain(rows, libraries)
    width = alignment.aligner(*A, B).width
    assert {divmod(r.pair, width): r.n for r in alignment.pair_counts(docs).collect()} == dict(holders)


def test_query_over_the_table(spark, data, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    short = {i for i, t in rows if t is None or len(t) < 3000}
    found = {r.doc_id: r for r in QUERIES["op11_token_alignment"](spark, data).collect()}
    assert set(found) == {i for i, _ in rows}
    expected, *_ = plain([x for x in rows if x[0] in short], libraries)
    for key, *counts, best, total, digest in expected:
        r = found[key]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links] == counts and r.groups_sha256 == digest
        assert r.n_best <= r.n_links and r.count_sum >= total >= best
