"""Operator 11: alignment of two tokenizers' tokens by the bytes of the text that they share.

Both encode a space and the text.  Tokens end at the running sums of their bytes; where a token
of each ends, the text is cut into groups, and two tokens are linked if their bytes overlap.
A link's count is the number of documents that hold its pair of ids linked anywhere.

A text is aligned in parts, cut where a single space or line end stands between other characters: no
token of either vocabulary goes across such a cut, so groups and links lie within parts.  The parts of a
slice of texts that are not known yet are aligned together as flat arrays; known parts come
from a bounded table.  A document keeps its distinct pairs and how often it has each, packed.
Tasks count their documents' pairs, and sums over salted pairs are summed again, so neither a
frequent pair nor a large source meets in one task.  The counts, at most one for each pair
of ids, go to every task as sorted arrays if they are few enough (`FEW_PAIRS`); else the pairs are
joined to them, salted.

Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no
tokens: zeros and an empty digest, and nothing of them is counted.  Documents are told apart by
row, so repeated rows and repeated or null keys count one by one.  Ties for an id's highest
count are all best.  Texts of any length are read whole; an empty table gives an empty one.
Only key and text are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SPACE, codec
from .common import pack, ready, release, replayable, unpack, written
from .words import slices

#: Pairs of ids up to which their counts go to every task.
FEW_PAIRS = 2_000_000
#: Salts of a pair; pairs that a task counts before it hands them on.
SALTS, HELD_PAIRS = 16, 1_000_000
#: Parts (and bytes of their groups) in a generation of the table of known parts; longest part that is looked up again.
KNOWN_PARTS, KNOWN_BYTES, LONGEST = 200_000, 48 << 20, 64

_SAFE_CUT = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n\S))")
_SOLID = re.compile(r"\n?[^\s\u2581]+").fullmatch
_UNSAFE = re.compile(r"\s\s")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def parts_of(text: str) -> list[str]:
    """Parts of a space and the text.  A part stands for itself if it begins with a space or a line end, else for a
    space and itself.  Cuts are single spaces, and the places before single line ends, between other characters."""
    if text[0].isspace() or text[-1].isspace() or _UNSAFE.search(text):
        first, *others = _SAFE_CUT.split(text)
        return [" " + first if first[0].isspace() else first, *others]
    return text.replace("\n", " \n").split(" ")


def spelled_out(part: str) -> str:
    return part if part[0] in " \n" else " " + part


class Known:
    """Aligned parts: their groups as text, counts (-1: not given back byte for byte) and linked pairs."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.bytes = 0
        self.counts = np.zeros((0, 4), np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # where each part's pairs begin

    def add(self, parts: list[str], groups: list[str], counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Numbers of the added parts; `pairs`: those of all parts, one after another."""
        base = len(self.groups)
        self.at.update((p, base + i) for i, p in enumerate(parts) if len(p) <= LONGEST)
        self.groups += groups
        self.bytes += sum(map(len, groups))
        n = base + len(groups)
        if n > len(self.counts):
            more = np.zeros((max(n, 2 * len(self.counts), 4096), 4), np.int64)
            more[:base] = self.counts[:base]
            first = np.zeros(len(more) + 1, np.int64)
            first[: base + 1] = self.first[: base + 1]
            self.counts, self.first = more, first
        self.counts[base:n] = counts
        self.first[base + 1 : n + 1] = self.first[base] + np.cumsum(np.maximum(counts[:, 3], 0))
        end = int(self.first[n])
        if end > len(self.pairs):
            wider = np.zeros(max(end, 2 * len(self.pairs), 8192), np.int64)
            wider[: self.first[base]] = self.pairs[: self.first[base]]
            self.pairs = wider
        self.pairs[self.first[base] : end] = pairs
        return np.arange(base, n)

    def pairs_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of parts, one after another, and which of `at` each belongs to."""
        n = self.first[at + 1] - self.first[at]
        owner = np.repeat(np.arange(len(at)), n)
        return self.pairs[np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)], owner


class Aligner:
    """Aligns texts by a byte-level `.json` vocabulary and its pattern (A) and a sentencepiece model that adds a space (B)."""

    def __init__(self, a: str, pattern: str, b: str):
        self.a, self._b_path = codec(a, pattern), b
        self.known, self.older = Known(), Known()

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self._b_path)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        return self.a.token_bytes()

    @cached_property
    def b_bytes(self) -> list[bytes]:
        piece = self.b.id_to_piece
        return [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]

    @cached_property
    def width(self) -> int:
        """A pair is A id * width + B id."""
        return len(self.b_bytes)

    @cached_property
    def _sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    @cached_property
    def _digits(self) -> list[str]:
        return [str(i) for i in range(max(len(self.a_bytes), self.width))]

    @cached_property
    def _bare(self):
        """A's merges alone, for matches of its pattern in the byte alphabet with line ends between them."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer(self.a.tokenizer.model)
        bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        return bare

    def _matches(self, part: str) -> list[str]:
        if part.isascii():
            if part.isalpha():
                return [SPACE + part]
            if part[-1] in ".," and part[:-1].isalpha():
                return [SPACE + part[:-1], part[-1]]
        return self.a.spelled_matches(spelled_out(part))

    def _same(self, a: np.ndarray, b: np.ndarray, raw: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist()))

    def _flat(self, parts: list[str]) -> tuple[np.ndarray, ...] | None:
        """Ids of A and B of all parts, one after another, and where the parts end; None if a token goes across parts or a tokenizer
        doesn't give the bytes back."""
        raw = [spelled_out(p).encode() for p in parts]
        stops = np.cumsum([len(r) for r in raw])
        a = np.array(self._bare.encode_batch_fast(["\n".join([m for p in parts for m in self._matches(p)])])[0].ids, np.int64)
        whole = b"".join(raw)
        b = self._b_ids(whole.decode())
        for ids, sizes in ((a, self._sizes[0]), (b, self._sizes[1])):
            ends = np.cumsum(sizes[ids])
            at = np.searchsorted(ends, stops)
            if not len(ends) or at[-1] >= len(ends) or not np.array_equal(ends[at], stops):
                return None
        return (a, b, stops) if self._same(a, b, whole) else None

    def _b_ids(self, raw: str) -> np.ndarray:
        """B's ids of a text that begins with a space, which B adds itself, or with a line end, for which its space goes again."""
        return np.array(self.b.encode(raw[1:]) if raw[0] == " " else self.b.encode(raw)[1:], np.int64)

    def _single(self, part: str) -> tuple[np.ndarray, ...] | None:
        """The same of one part of any kind."""
        raw = spelled_out(part)
        a, b = np.frombuffer(self.a.encode_once(raw), "<u4").astype(np.int64), self._b_ids(raw)
        return (a, b, np.array([len(raw.encode())])) if self._same(a, b, raw.encode()) else None

    def align(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups, counts and pairs of parts."""
        solid = [p for p in parts if _SOLID(p)]
        flat = self._flat(solid) if solid else None
        if flat is not None and len(solid) == len(parts):
            return self._grouped(*flat)
        known: dict[str, tuple] = {}
        if flat is not None:
            groups, counts, pairs = self._grouped(*flat)
            known = dict(zip(solid, zip(groups, counts, np.split(pairs, np.cumsum(counts[:-1, 3])), strict=True), strict=True))
        for part in parts:
            if part not in known:
                one = self._single(part)
                if one is None:
                    known[part] = ("", np.full(4, -1, np.int64), np.zeros(0, np.int64))
                else:
                    groups, counts, pairs = self._grouped(*one)
                    known[part] = (groups[0], counts[0], pairs)
        out = [known[p] for p in parts]
        return [x[0] for x in out], np.stack([x[1] for x in out]), np.concatenate([x[2] for x in out])

    def _grouped(self, a: np.ndarray, b: np.ndarray, stops: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups, counts and pairs of parts that end at the bytes `stops`, from their ids, one after another."""
        ends_a, ends_b = np.cumsum(self._sizes[0][a]), np.cumsum(self._sizes[1][b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        label_a, label_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)  # group of each token
        # A's tokens overlap B's from the one that ends behind their start to the one that reaches their end
        first = np.searchsorted(ends_b, ends_a - self._sizes[0][a], "right")
        n = np.searchsorted(ends_b, ends_a, "left") - first + 1
        left = np.repeat(np.arange(len(a)), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        until = [np.searchsorted(x, stops, "right") for x in (ends_a, ends_b, cuts)]
        linked = np.cumsum(n)[until[0] - 1]
        counts = np.stack([np.diff(x, prepend=0) for x in (*until, linked)], axis=1)
        digits = self._digits
        sides = []
        for ids, label in ((a.tolist(), label_a), (b.tolist(), label_b)):
            at = np.searchsorted(label, np.arange(len(cuts) + 1)).tolist()
            names = [digits[t] for t in ids]
            sides.append([names[x] if y == x + 1 else ",".join(names[x:y]) for x, y in zip(at, at[1:], strict=False)])
        spelled = [f"{x}|{y}" for x, y in zip(*sides, strict=True)]
        edges = [0, *until[2].tolist()]
        groups = [spelled[x] if y == x + 1 else ";".join(spelled[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
        return groups, counts, a[left] * self.width + b[right]

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of the parts among the known ones, into which new ones are taken."""
        found = list(map(self.known.at.get, parts))
        if None in found:
            missing = list(dict.fromkeys(p for p, at in zip(parts, found, strict=True) if at is None))
            own: dict[str, int] = {}
            old = [p for p in missing if p in self.older.at]
            if old:
                at = np.array([self.older.at[p] for p in old])
                own.update(zip(old, self.known.add(old, [self.older.groups[i] for i in at], self.older.counts[at], self.older.pairs_of(at)[0]).tolist(), strict=True))
            new = [p for p in missing if p not in own]
            if new:
                own.update(zip(new, self.known.add(new, *self.align(new)).tolist(), strict=True))
            found = [own[p] if at is None else at for p, at in zip(parts, found, strict=True)]
        return np.array(found, np.int64)

    def texts(self, texts: list[str | None]) -> Iterator[tuple]:
        """The counts, groups' digest and packed pairs (ids of pairs, ascending, and how often) of each text."""
        if len(self.known.groups) >= KNOWN_PARTS or self.known.bytes >= KNOWN_BYTES:
            self.older, self.known = self.known, Known()
        cut = [parts_of(t) if t else [] for t in texts]
        at = self.numbers([p for parts in cut for p in parts])
        bounds = np.cumsum([0, *map(len, cut)])
        counts = self.known.counts[at] if len(at) else np.zeros((0, 4), np.int64)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts, axis=0)])
        totals = sums[bounds[1:]] - sums[bounds[:-1]]
        bad = np.concatenate([[0], np.cumsum(counts[:, 0] < 0)])
        good = (bounds[1:] > bounds[:-1]) & (bad[bounds[1:]] == bad[bounds[:-1]])
        pairs, owner = self.known.pairs_of(at) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        doc = np.searchsorted(bounds, owner, "right") - 1
        most = self.width * len(self.a_bytes)
        keyed = np.sort(doc * most + pairs)  # a slice has few documents
        head = np.flatnonzero(np.diff(keyed, prepend=-1))
        often = np.diff(np.append(head, len(keyed)))
        edges = np.searchsorted(keyed[head], np.arange(len(texts) + 1) * most)
        pairs = keyed[head] % most
        for i in range(len(texts)):
            if good[i]:
                text = ";".join(map(self.known.groups.__getitem__, at[bounds[i] : bounds[i + 1]].tolist()))
                x, y = edges[i], edges[i + 1]
                yield (*totals[i].tolist(), hashlib.sha256(text.encode()).hexdigest(), pack(pairs[x:y], often[x:y]))
            else:
                yield (0, 0, 0, 0, "", None)


@lru_cache(maxsize=2)
def aligner(a: str, pattern: str, b: str) -> Aligner:
    """One aligner for each pair of vocabularies and worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(a, pattern, b)


def aligned(frame: DataFrame, a: str, pattern: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, n_a, n_b, n_groups, n_links, groups_sha256 and the packed pairs of every text."""
    rows = replayable(frame.select(F.col(key).alias("key"), F.col(text).alias("text"))).withColumn("row", F.monotonically_increasing_id()).select("row", "key", "text")
    schema = T.StructType([*rows.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType())])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, pattern, b)
        for batch in batches:
            for part in slices(batch):
                found = list(own.texts(part.column("text").to_pylist()))
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], schema.fieldNames())
        release()

    return rows.mapInArrow(work, schema)


def pair_counts(docs: DataFrame) -> DataFrame:
    """pair and n, the documents that hold it: counted by task, then by salted pair, then by pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        held: list[np.ndarray] = []
        pairs, n, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            all_pairs = np.concatenate([pairs, *held])
            weights = np.concatenate([n, np.ones(len(all_pairs) - len(pairs), np.int64)])
            found, place = np.unique(all_pairs, return_inverse=True)
            return found, np.bincount(place, weights, len(found)).astype(np.int64)

        for batch in batches:
            for data in batch.column(0).to_pylist():
                if data:
                    held.append(unpack(data)[0].astype(np.int64))
                    waiting += len(held[-1])
            if waiting >= HELD_PAIRS:
                (pairs, n), waiting = merged(), 0
                held.clear()
                if len(pairs) >= HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n), pa.array(np.full(len(n), salt, np.int32))], ["pair", "n", "salt"])
                    pairs, n = pairs[:0], n[:0]
        pairs, n = merged()
        for x in range(0, len(n), 1 << 16):
            y = slice(x, x + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[y]), pa.array(n[y]), pa.array(np.full(len(n[y]), salt, np.int32))], ["pair", "n", "salt"])

    each = docs.select("pairs").mapInArrow(work, "pair long, n long, salt int")
    return each.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, width: int) -> DataFrame:
    """pair, n and best: whether no other pair of its A id has a higher count."""
    named = counts.withColumn("a", F.floor(F.col("pair") / width))
    top = named.groupBy("a").agg(F.max("n").alias("top"))
    return named.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _looked_up(docs: DataFrame, counts: DataFrame, schema: T.StructType) -> DataFrame:
    """n_best and count_sum by sorted arrays that every task has."""
    table = counts.toArrow()
    pairs = table["pair"].to_numpy()
    order = np.argsort(pairs)
    shared = docs.sparkSession.sparkContext.broadcast((pairs[order], table["n"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, 2), np.int64)
            for i, data in enumerate(batch.column("pairs").to_pylist()):
                if data:
                    own, often = (x.astype(np.int64) for x in unpack(data))
                    at = np.searchsorted(pairs, own)
                    out[i] = often @ best[at], often @ n[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out[:, 0]), pa.array(out[:, 1])], schema.fieldNames())

    return docs.mapInArrow(work, schema)


def _joined(docs: DataFrame, counts: DataFrame, schema: T.StructType) -> DataFrame:
    """n_best and count_sum by a salted join of the documents' pairs with the counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data:
                    own, often = (x.astype(np.int64) for x in unpack(data))
                    for x in range(0, len(own), 1 << 16):
                        y = slice(x, x + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[y]), row)), pa.array(own[y]), pa.array(often[y])], ["row", "pair", "often"])

    each = docs.select("row", "pairs").mapInArrow(work, "row long, pair long, often long").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = each.join(copies, ["pair", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("n")).alias("count_sum"))
    return docs.drop("pairs").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(schema.fieldNames())


def align(frame: DataFrame, a: str, pattern: str, b: str, key: str = "doc_id", text: str = "text", few_pairs: int = FEW_PAIRS) -> tuple[DataFrame, DataFrame]:
    """The documents (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and the pairs (a_id, b_id, n, best)."""
    ready(frame.sparkSession)
    width = aligner(a, pattern, b).width
    docs = written(aligned(frame, a, pattern, b, key, text), "aligned")
    counts = written(with_best(written(pair_counts(docs), "pairs"), width), "counts")
    schema = T.StructType([*docs.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")]])
    out = (_looked_up if counts.count() <= few_pairs else _joined)(docs, counts, schema)
    pairs = counts.select(F.floor(F.col("pair") / width).alias("a_id"), (F.col("pair") % width).alias("b_id"), "n", "best")
    return out.select(F.col("key").alias(key), *_COUNTS, "n_best", "count_sum", "groups_sha256"), pairs
