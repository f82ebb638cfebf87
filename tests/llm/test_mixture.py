import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import mixture
from lodestone.llm.queries import QUERIES
from lodestone.llm.word_bpe import word_codec

from .conftest import SCHEMA, prose

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check_pieces(rows, texts, library, window=2048):
    """Every id once, sequences gapless and full or of a power of two, checksums of the library's own ids."""
    wanted = sorted((i, *library.encode(t or "", add_special_tokens=False).ids, 1) for i, t in texts)
    held, sequences = {}, {}
    for r in rows:
        held.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    by_key = {}
    for i, *ids in wanted:
        by_key.setdefault(i, []).append(ids)
    assert set(by_key) == set(held)
    for i, lists in by_key.items():
        assert sum(r.length for r in held[i]) == sum(map(len, lists))
        for r in held[i]:
            own = [ids for ids in lists if len(ids) == r.doc_tokens]
            assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in own)
        if len(lists) == 1:
            spans = sorted((r.start, r.length) for r in held[i])
            assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans]).tolist()][:-1]


def test_words_are_encoded_as_the_library_does(library):
    r = random.Random(3)
    letters = [*"ab Ab .,'stlld\n\r\t\x1c\x85\xa0é́漢🙂İΣς12_-<|>", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "  ", "é", "́"]
    coder = word_codec(PATH)
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(coder.encode_bytes(text), coder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def plain_rounds(queue, sizes, deficit, quantum, grain):
    """The order of service by a round-robin that is run round by round."""
    waiting = {q: [] for q in range(len(quantum))}
    for d, (q, n) in enumerate(zip(queue, sizes, strict=True)):
        waiting[q] += [(d, a, min(grain, n - a)) for a in range(0, n, grain)]
    have, out = list(deficit), []
    while any(waiting.values()):
        for q in range(len(quantum)):
            have[q] += quantum[q]
            while waiting[q] and waiting[q][0][2] <= have[q] + 1e-9 * quantum[q]:
                have[q] -= waiting[q][0][2]
                out.append(waiting[q].pop(0))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_service_equals_a_round_robin_run_round_by_round(seed):
    r = np.random.default_rng(seed)
    share = r.dirichlet(np.ones(5) / (1 + seed)) + 1e-3
    queue, sizes = r.integers(0, 5, 300), r.integers(1, 900, 300)
    deficit = r.normal(0, 400, 5)
    doc, start, length, sequence, offset = mixture.serve(queue, sizes, deficit, share / share.sum() * 256, 256, 100)
    stream = [(d, a + i) for d, a, n in plain_rounds(queue, sizes, deficit, share / share.sum() * 256, 100) for i in range(n)]
    assert [(d, a + i) for d, a, n in zip(doc, start, length, strict=True) for i in range(n)] == stream
    ends = np.cumsum(length)
    assert np.array_equal(np.flatnonzero(offset == 0), np.flatnonzero(np.diff(sequence, prepend=-1)))
    assert all(o + n <= 256 for o, n in zip(offset, length, strict=True)) and ends[-1] == sizes.sum()


def test_packing_of_edges(edges, nothing, library):
    texts = [(r.doc_id, r.text) for r in edges.collect()]
    plain = [(i, t) for i, t in texts if i is not None]
    rows = mixture.pack_mixture(edges, PATH, part_bytes=1 << 20).collect()
    check_pieces([r for r in rows if r.doc_id is not None], plain, library) if all(i is not None for i, _ in texts) else None
    assert sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert mixture.pack_mixture(nothing, PATH).collect() == []
    with pytest.raises(ValueError):
        mixture.pack_mixture(edges, PATH, window=0)


def test_windows_follow_their_targets_over_parts(spark):
    """One source holds half of the tokens, 30 others the rest; at any point of any part none is off by more than a piece and a round."""
    r = random.Random(1)
    rows = [(i, prose(i, r.randint(5, 900)), "en", "hot" if i % 2 else f"s{i % 30}", 0) for i in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixture.pack_mixture(docs, PATH, part_bytes=1 << 18).orderBy("sequence_id", "offset").collect()
    assert len({x.sequence_id >> 32 for x in out}) > 3
    total = sum(x.length for x in out)
    share = {}
    for x in out:
        share[x.source] = share.get(x.source, 0) + x.length / total
    seen, done, worst = dict.fromkeys(share, 0), 0, 0.0
    last = {}
    for i, x in enumerate(out):
        last[x.sequence_id >> 32] = i
    for i, x in enumerate(out):
        seen[x.source] += x.length
        done += x.length
        if last[x.sequence_id >> 32] != i and done < 0.9 * total:
            worst = max(worst, max(abs(seen[s] - p * done) for s, p in share.items()))
    # near its end a part has what is left of its own queues, so the bound is a few pieces
    assert worst < 6 * mixture.WINDOW
    check_pieces(out, [(i, t) for i, t, *_ in rows], Tokenizer.from_file(PATH))


def test_given_targets_and_sources_without_one(spark):
    rows = [(i, prose(i, 200), "en", ("a", "b", None)[i % 3], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixture.pack_mixture(docs, PATH, targets={"a": 3, "b": 1}, part_bytes=1 << 30, window=512, grain=128)
    by = {}
    for x in out.orderBy("sequence_id", "offset").collect():
        by.setdefault(x.sequence_id >> 32, []).append(x)
    for pieces in by.values():
        a = [x.length for x in pieces if x.source == "a"]
        until = next(i for i in reversed(range(len(pieces))) if pieces[i].source == "a")
        head = pieces[: until + 1]
        b = sum(x.length for x in head if x.source == "b")
        assert not [x for x in head if x.source is None]
        if pieces is by[0]:  # nothing was owed before
            assert abs(b - sum(a) / 3) < 2 * 512
    with pytest.raises(ValueError):
        mixture.owed(out.select((F.col("sequence_id") * 0).alias("part"), "source", F.col("length").alias("n")), {"a": -1})


def test_deficits_pass_from_part_to_part(spark):
    totals = spark.createDataFrame([(0, "a", 100), (0, None, 300), (1, "a", 300), (1, None, 100), (2, "a", 10)], "part int, source string, n long")
    found = {(r.part, r.source): (r.share, r.deficit) for r in mixture.owed(totals).collect()}
    share = 410 / 810
    assert found[0, "a"] == pytest.approx((share, 0)) and found[1, "a"] == pytest.approx((share, share * 400 - 100))
    assert found[1, None] == pytest.approx((1 - share, (1 - share) * 400 - 300)) and found[2, "a"] == pytest.approx((share, share * 800 - 400))


def test_query_over_the_table(spark, data, library):
    rows = QUERIES["op12_mixture_packing"](spark, data).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check_pieces(rows, texts, library)
