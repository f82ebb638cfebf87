import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import token_files, tokenize
from lodestone.llm.bpe import codec, read_ranks
from lodestone.llm.common import scratch
from lodestone.llm.queries import QUERIES, vocabulary

RANKS, JSON = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS[0]), special_tokens={})


def strange_texts() -> list[str]:
    r = random.Random(5)
    letters = list("ab '  \n\t\r \x1c\x85\xa0é漢🙂12_-.,s'tll") + ["<|endoftext|>", "'re", "  "]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(3000)]


def test_encoders_agree_with_the_libraries(exact):
    library = Tokenizer.from_file(JSON[0])
    a, b = codec(*RANKS), codec(*JSON, added=True)
    for text in strange_texts():
        assert a.encode(text).tolist() == exact.encode_ordinary(text)
        found = library.encode(text, add_special_tokens=False)
        assert b.encode(text).tolist() == found.ids
        assert a.decode(a.encode(text)) == text


def test_known_parts_move_on_between_generations(exact, monkeypatch):
    from lodestone.llm import bpe

    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 20)
    own, r = bpe.Codec(*RANKS), random.Random(8)
    for _ in range(400):
        text = " ".join(r.choice(["alpha", "beta.", f"w{r.randint(0, 90)}", f"word{r.choice('abcdefgh')},", "é-漢"]) for _ in range(6))
        assert own.encode(text).tolist() == exact.encode_ordinary(text)
    assert own._older and len(own._of_part) <= 30


def test_offsets_and_split_characters():
    coder = codec(*JSON)
    library = Tokenizer.from_file(JSON[0])
    for text in ("plain words here", "é漢🙂 x", "a🙂🙂b"):
        found = library.encode(text, add_special_tokens=False)
        begins, ends = coder.offsets(np.array(found.ids))
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == found.offsets
    ids = coder.encode("🙂")
    assert len(ids) > 1 and coder.decode(ids) == "🙂" and "�" in coder.decode(ids[:1])


def test_round_trip_of_edges(edges, nothing, exact):
    rows = tokenize.digests(edges, *RANKS).collect()
    assert len(rows) == edges.count()
    expected = sorted((len(exact.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for (t,) in edges.select("text").collect())
    assert sorted((r.n_tokens, r.decoded_sha256) for r in rows) == expected
    spans = tokenize.encode(edges, *RANKS, offsets=True).filter("doc_id = 6").first()
    assert spans.begins == [0] and spans.ends == [4]
    assert tokenize.digests(nothing, *RANKS).collect() == []


def test_token_files_of_edges(spark, edges, nothing):
    folder = scratch(spark, "test-files")
    shards = token_files.write(edges, folder, *JSON, shard_bytes=4000)
    rows = token_files.read(shards, folder).collect()
    texts = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    ordered = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at = 0
    for row, (key, text) in zip(sorted(rows, key=lambda r: r.start), ordered, strict=True):
        ids = codec(*JSON).encode(text or "").tolist() + [0]
        assert (row.doc_id, row.start, row.n_tokens, np.frombuffer(row.ids, "<u4").tolist()) == (key, at, len(ids), ids)
        at += len(ids)
    assert token_files.round_trip(nothing, *JSON).collect() == []


def test_queries_over_the_table(spark, data, exact):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    library = Tokenizer.from_file(JSON[0])
    for r in QUERIES["op1_bpe_round_trip"](spark, data).collect():
        ids = np.array(exact.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    at = 0
    for r in sorted(QUERIES["op6_token_files"](spark, data).collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(docs[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_added_tokens_have_their_own_ids(spark):
    library = Tokenizer.from_file(JSON[0])
    texts = [*strange_texts()[:500], "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> \n b", "<|endoftext|" + "x " * 50]
    coder = codec(*JSON, added=True)
    expected = {}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == ids and coder.decode(coder.encode(text)) == text
        expected[i] = np.array([*ids, 0], "<u4")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = 0
    for r in sorted(token_files.round_trip(docs, *JSON).collect(), key=lambda r: r.doc_id):
        ids = expected[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
