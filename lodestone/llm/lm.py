"""Operator 3: language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Every word that stands before another has a restaurant of its own, whole words, as many as the
corpus has; all share one parent, the restaurant of all words, whose base is uniform over the
known words and one unknown.  A table of a restaurant is a customer of its parent.

1.  Blocks of documents send each bucket its distinct pairs (context, word) with their counts, and
    keep for each token the place of its pair.  A bucket holds all pairs of a context; a
    context too frequent for one bucket is split by the word.  Which are, an exact histogram of
    all contexts' hashes tells; it decides where pairs go, not what they score.
2.  Buckets and words' owners exchange sums: a bucket sends the tables of each of its words (and
    the totals of split contexts), an owner adds them up, seats the parent's customers and answers.
    Only scalars reach the driver.
3.  Gibbs sampling in rounds: each round seats the customers of every dish anew, given the seats of
    all other dishes as the last round left them, with the dish's own customers and tables taken
    out.  Up to `SMALL` customers the number of tables comes from its exact conditional (generalised
    Stirling numbers); beyond, one of `PARTICLES` seatings by the Chinese restaurant process is chosen
    by its weight, customers beyond the `SMALL`-th in steps of an eighth (means within 5 % of the
    exact ones in the tests).
4.  The predictive probabilities after the last `SAMPLES` rounds are averaged; the values go back to
    the blocks, one for each distinct pair of a block, and are summed there by document.

Random numbers are functions of seed, round, context and word, and rounds use the totals of the
round before, so scores don't depend on how the rows lie in files or buckets.

Discounts come from the counts of ones and twos; concentrations are parameters.  Null and empty
texts consist of the end alone; null keys are like the empty text's key for the split; repeated
rows and keys are scored row by row; ties have no effect; texts of any length are read whole; an
empty table gives an empty table; only key and text are read, so no column can clash.  Words are
identified by 64-bit hashes, and a word's logarithm travels as a 32-bit float.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pack, parts_for, ready, release, replayable, unpack
from .words import END, mix, slices, words_of

#: Tokens and documents of a block, bytes of input for each bucket.
BLOCK_TOKENS, BLOCK_DOCS, BUCKET_BYTES, LEAST_BUCKETS = 1_500_000, 1 << 17, 10 << 20, 6
#: Cells of the histogram of contexts.
CELLS = 1 << 16
ROUNDS, SAMPLES = 3, 2
THETA = (1.0, 1.0)
SMALL, PARTICLES = 32, 8


def held_out(key: int | None, folds: int = 7, fold: int = 2) -> bool:
    """Whether the key's text has the held-out remainder."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % folds == fold


def steps(rising: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, which pack smaller than these."""
    return np.diff(rising, prepend=rising.dtype.type(0)).astype(rising.dtype)


def summed(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences.astype(np.uint64), dtype=np.uint64)


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from key and salt."""
    for s in salt:
        key = mix(key ^ mix(np.array([s + 1], np.uint64)))
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context) + word)


def bucket_of(context: np.ndarray, word: np.ndarray, splits: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a pair: its context's; of a split context, one of several by the word."""
    n = splits[(context & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    return (mix(context + mix(word) % n * END) % np.uint64(buckets)).astype(np.int64)


def owner_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key ^ END) % np.uint64(buckets)).astype(np.int64)


def stirling(d: float, n: int = SMALL) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of c customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, n):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - d * t)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, 0 : c + 1])
    return out


def tables(c: np.ndarray, key: np.ndarray, base: np.ndarray, d: float, p: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Tables of each dish of c customers, drawn given all other dishes: `base` is the
    concentration and the discount times the others' tables, p the dish's probability at the parent."""
    out = np.minimum(c, 1)
    log_s = stirling(d)
    for n in range(2, SMALL + 1):
        of_n = np.flatnonzero(c == n)
        for at in (of_n[a : a + (1 << 16)] for a in range(0, len(of_n), 1 << 16)):
            logs = np.cumsum(np.log((base[at, None] + d * np.arange(n)) * p[at, None]), axis=1) + log_s[n, 1 : n + 1]
            chances = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            u = uniform(key[at], seed, turn) * chances[:, -1]
            out[at] = np.minimum(1 + (chances <= u[:, None]).sum(axis=1), n)
    big = np.flatnonzero(c > SMALL)
    big = big[np.argsort(c[big], kind="stable")]  # dishes of like size share their steps
    for at in (big[a : a + (1 << 12)] for a in range(0, len(big), 1 << 12)):
        out[at] = _seated(c[at], key[at], base[at], d, p[at], seed, turn)
    return out


def _seated(c: np.ndarray, key: np.ndarray, base: np.ndarray, d: float, p: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """For dishes of many customers: seatings in which a new table's weight is scaled by what it takes
    from the weights of all later customers (by their mean), each with its importance weight."""
    ladder, seated = [], 1
    while seated < c.max():
        ladder.append((seated, 1 if seated < SMALL else max(1, seated // 8)))
        seated += ladder[-1][1]
    steps = np.stack([np.clip(c - at, 0, step) for at, step in ladder]).astype(float)
    later = np.stack([d * np.log(np.minimum(1, at / c)) for at, _ in ladder])
    for _ in range(4):
        mean, total = np.ones(len(c)), np.empty_like(later)
        for k, (at, _) in enumerate(ladder):
            new = (base + d * mean) * p * np.exp(later[k])
            total[k] = np.maximum(at - d * mean, 1 - d) + new
            mean = np.minimum(mean + steps[k] * new / total[k], at + steps[k])
        gone = steps * np.log1p(-np.minimum(d / total, 0.95))
        later = np.cumsum(gone[::-1], axis=0)[::-1] - gone / 2
    keys = mix(key + np.arange(PARTICLES, dtype=np.uint64)[:, None] * END)
    t, weight = np.ones((PARTICLES, len(c))), np.zeros((PARTICLES, len(c)))
    for k, (at, size) in enumerate(ladder):
        step = steps[k]
        new, old = (base + d * t) * p * np.exp(later[k]), at - d * t
        chance = new / (new + old)
        u = uniform(keys, seed, turn, at)
        mean = step * chance
        more = u < mean
        if size > 1:
            normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform(keys, seed, turn, at, 1))
            more = np.where(mean < 1, more, np.clip(np.rint(mean + np.sqrt(mean * (1 - chance)) * normal), 0, step))
        weight += step * np.log(new + old) - more * later[k]
        t += more
    share = np.cumsum(np.exp(weight - weight.max(axis=0)), axis=0)
    pick = (share <= uniform(keys[0], seed, turn, 0) * share[-1]).sum(axis=0)
    return t[np.minimum(pick, PARTICLES - 1), np.arange(len(c))].astype(c.dtype)


def root_chance(m: dict, c1: np.ndarray, t1: np.ndarray, less: np.ndarray | int = 0) -> np.ndarray:
    """Probability of words at the restaurant of all words; `less`: customers taken out of it."""
    left = c1 - less
    rest = (THETA[0] + m["d1"] * m["T1"]) / (m["V"] + 1)
    return (np.maximum(left - m["d1"] * np.minimum(t1, left), 0) + rest) / (THETA[0] + m["C1"] - less)


class Block:
    """Distinct pairs of a block of documents in the order of their buckets."""

    def __init__(self, parts: list[tuple[pa.Array, object]], splits: np.ndarray, buckets: int):
        keys = pa.concat_arrays([k for k, _ in parts])
        sizes = np.concatenate([w.counts for _, w in parts]) + 1  # and the end
        held = np.array([held_out(k) for k in keys.to_pylist()], dtype=bool)
        token = np.full(int(sizes.sum()), END, dtype=np.uint64)
        inner = np.ones(len(token), dtype=bool)
        inner[np.cumsum(sizes) - 1] = False
        token[inner] = np.concatenate([w.hash for _, w in parts])
        name, rank = np.unique(token, return_inverse=True)
        before = np.concatenate([[np.searchsorted(name, END)], rank[:-1]])  # an end stands before each text
        code, place = np.unique(before * len(name) + rank, return_inverse=True)
        trained = np.bincount(place, weights=np.repeat(~held, sizes), minlength=len(code)).astype(np.int64)
        context, word = code // len(name), code % len(name)
        bucket = bucket_of(name[context], name[word], splits, buckets)
        order = np.argsort(bucket, kind="stable")
        where = np.empty(len(order), dtype=np.int64)
        where[order] = np.arange(len(order))
        self.name, self.context, self.word, self.trained = name, context[order], word[order], trained[order]
        self.edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sink = pa.BufferOutputStream()
        meta = pa.record_batch({"key": keys, "n_tokens": pa.array(sizes), "held_out": pa.array(held)})
        with pa.ipc.new_stream(sink, meta.schema) as out:
            out.write_batch(meta)
        self.meta = pickle.dumps((sink.getvalue().to_pybytes(), pack(where[place])))

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        """Bucket and its pairs: names, contexts and the lengths of their runs, words, counts."""
        for b in np.flatnonzero(np.diff(self.edges)):
            at = slice(self.edges[b], self.edges[b + 1])
            context, word = self.context[at], self.word[at]
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            used = np.unique(np.concatenate([context[first], word]))
            yield int(b), pack(steps(self.name[used]), steps(np.searchsorted(used, context[first])), np.diff(np.append(first, len(word))), np.searchsorted(used, word), self.trained[at])


class Bucket:
    """Pairs of one bucket, in the order of context and word, and their seating."""

    def __init__(self, payloads: list[tuple[int, bytes]], splits: np.ndarray, buckets: int, seed: int):
        self.seed = seed
        names, contexts, words, counts, self.blocks = [], [], [], [], []
        base = 0
        for block, data in payloads:
            name, context, run, word, count = unpack(data)
            names.append(summed(name))
            contexts.append(np.repeat(summed(context).astype(np.int64) + base, run))
            words.append(word.astype(np.int64) + base)
            counts.append(count.astype(np.int64))
            self.blocks.append((block, len(word)))
            base += len(name)
        self.name, inverse = np.unique(np.concatenate(names), return_inverse=True)
        code = inverse[np.concatenate(contexts)] * len(self.name) + inverse[np.concatenate(words)]
        del names, contexts, words, inverse
        pair, self.place = np.unique(code, return_inverse=True)
        self.c = np.bincount(self.place, weights=np.concatenate(counts), minlength=len(pair)).astype(np.int64)
        context, word = pair // len(self.name), pair % len(self.name)
        at, self.g = np.unique(context, return_inverse=True)
        self.context = self.name[at]
        at, self.w = np.unique(word, return_inverse=True)
        self.word = self.name[at]
        del code, pair, context, word
        self.split = splits[(self.context & np.uint64(CELLS - 1)).astype(np.int64)] > 1
        self.t = np.minimum(self.c, 1)
        # words and split contexts in the order of their owners
        self.order = [np.lexsort((k, owner_of(k, buckets))) for k in (self.word, self.context[self.split])]
        self.slices = [np.searchsorted(np.sort(owner_of(k, buckets)), np.arange(buckets + 1)) for k in (self.word, self.context[self.split])]

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words, and of the contexts."""
        return (np.bincount(self.w, weights=values, minlength=len(self.word)).astype(np.int64), np.bincount(self.g, weights=values, minlength=len(self.context)).astype(np.int64))

    def messages(self, turn: int) -> Iterator[tuple[int, bytes]]:
        """What the owners need: in the first turn keys, customers and tables of all words; later the tables of those that
        may change, those with a pair of more than one customer somewhere, as both sides know."""
        t_word, t_context = self.sums(self.t)
        c_word, c_context = self.sums(self.c)
        alone = np.array([(self.c == 1).sum(), (self.c == 2).sum()])
        for owner in range(len(self.slices[0]) - 1):
            w = self.order[0][slice(*self.slices[0][owner : owner + 2])]
            g = np.flatnonzero(self.split)[self.order[1][slice(*self.slices[1][owner : owner + 2])]]
            if turn:
                w = w[self.moving[w]]
                columns = [t_word[w], t_context[g]]  # in the order of the first turn's keys
            else:
                columns = [steps(self.word[w]), t_word[w], steps(self.context[g]), t_context[g], c_word[w], c_context[g], alone]
                alone = np.zeros(2, np.int64)
            if len(w) or len(g) or not turn and columns[-1].any():
                yield owner, pack(*columns)

    def answered(self, turn: int, answers: list[tuple[int, bytes]]) -> None:
        """Take in the owners' sums."""
        if not turn:
            self.count, self.c1, self.t1 = (np.zeros(len(self.word), np.int64) for _ in range(3))
            _, self.C = self.sums(self.c)
            self.moving = np.zeros(len(self.word), bool)
        _, self.T = self.sums(self.t)
        split = np.flatnonzero(self.split)
        for owner, data in answers:
            w = self.order[0][slice(*self.slices[0][owner : owner + 2])]
            g = split[self.order[1][slice(*self.slices[1][owner : owner + 2])]]
            c1, t1, t, *first = unpack(data)
            self.c1[w], self.t1[w], self.T[g] = c1, t1, t
            if first:
                self.count[w], self.C[g] = first
        if not turn:
            self.moving = self.count > self.c1

    def sweep(self, m: dict, turn: int) -> None:
        """Seat the customers of every dish anew, given all others."""
        at = np.flatnonzero(self.c > 1)
        g, w, old = self.g[at], self.w[at], self.t[at]
        p = root_chance(m, self.c1[w], self.t1[w], old)
        base = THETA[1] + m["d2"] * (self.T[g] - old)
        self.t[at] = tables(self.c[at], pair_key(self.context[g], self.word[w]), base, m["d2"], p, self.seed, turn)

    def chances(self, m: dict) -> np.ndarray:
        """Predictive probability of each pair."""
        own = np.maximum(self.c - m["d2"] * self.t, 0)
        opening = (THETA[1] + m["d2"] * self.T[self.g]) * root_chance(m, self.c1, self.t1)[self.w]
        return (own + opening) / (THETA[1] + self.C[self.g])


class Owner:
    """Sums over the buckets of a share of the words and split contexts; the words' tables at the root."""

    def __init__(self, first: list[tuple[int, bytes]], seed: int):
        self.seed = seed
        parts = [unpack(data) for _, data in first]
        self.buckets = [b for b, _ in first]
        self.word, self.at_word = np.unique(np.concatenate([summed(p[0]) for p in parts]), return_inverse=True)
        self.context, self.at_context = np.unique(np.concatenate([summed(p[2]) for p in parts]), return_inverse=True)
        self.sizes = [(len(p[0]), len(p[2])) for p in parts]
        add = lambda at, k, n: np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=n).astype(np.int64)
        self.c1, self.c = add(self.at_word, 1, len(self.word)), add(self.at_word, 4, len(self.word))
        self.T, self.C = add(self.at_context, 3, len(self.context)), add(self.at_context, 5, len(self.context))
        self.alone = sum(p[6].astype(np.int64) for p in parts)
        self.moving = self.c > self.c1
        self.t1 = np.minimum(self.c1, 1)

    def places(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each bucket with its words and contexts among the owner's."""
        a = b = 0
        for bucket, (n, k) in zip(self.buckets, self.sizes, strict=True):
            yield bucket, self.at_word[a : a + n], self.at_context[b : b + k]
            a, b = a + n, b + k

    def later(self, messages: list[tuple[int, bytes]], m: dict, turn: int) -> None:
        found, tables_of = dict(messages), np.zeros(len(self.word), np.int64)
        self.T = np.zeros(len(self.context), np.int64)
        for bucket, w, g in self.places():
            if bucket in found:
                t, total = unpack(found[bucket])
                tables_of[w[self.moving[w]]] += t.astype(np.int64)
                self.T[g] += total.astype(np.int64)
        self.c1 = np.where(self.moving, tables_of, self.c1)
        many = np.flatnonzero(self.c1 > 1)
        old = np.minimum(self.t1[many], self.c1[many])
        self.t1 = np.minimum(self.c1, 1)
        base = THETA[0] + m["d1"] * (m["T1"] - old)
        self.t1[many] = tables(self.c1[many], mix(self.word[many]), base, m["d1"], np.full(len(many), 1 / (m["V"] + 1)), self.seed, turn)

    def scalars(self) -> np.ndarray:
        return np.array([self.c.sum(), (self.c > 0).sum(), self.c1.sum(), self.t1.sum(), (self.c1 == 1).sum(), (self.c1 == 2).sum(), *self.alone], dtype=np.int64)

    def answers(self, turn: int) -> Iterator[tuple[int, bytes]]:
        for bucket, w, g in self.places():
            more = () if turn else (self.c[w], self.C[g])
            yield bucket, pack(self.c1[w], self.t1[w], self.T[g], *more)


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.05, 0.95))


def model_of(scalars: np.ndarray) -> dict:
    n, v, c1, t1, ones1, twos1, ones2, twos2 = (int(x) for x in scalars)
    return {"N": n, "V": v, "C1": c1, "T1": t1, "d1": _discount(ones1, twos1), "d2": _discount(ones2, twos2)}


def split_contexts(source: DataFrame, buckets: int) -> np.ndarray:
    """Buckets over which the contexts of each cell of hashes are dealt, so that none gets much more
    than half a bucket's share: from the count of all tokens by cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices(batch):
                found = words_of(part.column("text"))
                counts += np.bincount((found.hash & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                counts[int(END) & (CELLS - 1)] += part.num_rows
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": cell, "n": counts[cell]})

    counted = source.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counted = counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total"))))  # one row
    hot = counted.filter(F.col("n") * 2 * buckets > F.col("total")).select("cell", F.ceil(F.col("n") * 2 * buckets / F.col("total")).alias("splits"))
    out = np.ones(CELLS, np.int64)
    for row in hot.toLocalIterator():  # at most two for each bucket, and no more than cells
        out[row.cell] = min(row.splits, 2 * buckets)
    return out


def score(
    frame: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, samples: int = SAMPLES, seed: int = 11, buckets: int | None = None, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    from pyspark import TaskContext

    if not 0 < samples <= rounds:
        raise ValueError("samples are from 1 to the number of rounds")
    spark = ready(frame.sparkSession)
    source = replayable(frame.select(F.col(key).alias("key"), F.col(text).alias("text")))
    buckets = buckets or parts_for(source, BUCKET_BYTES, LEAST_BUCKETS)
    splits = split_contexts(source, buckets)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, tokens, rows, serial = [], 0, 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, tokens, rows, serial
            if parts:
                block = Block(parts, splits, buckets)
                parts, tokens, rows = [], 0, 0
                yield pa.RecordBatch.from_pydict({"bucket": [serial % buckets], "block": [serial], "kind": ["meta"], "data": [block.meta]})
                for b, data in block.payloads():
                    yield pa.RecordBatch.from_pydict({"bucket": [b], "block": [serial], "kind": ["pairs"], "data": [data]})
                serial += 1
                del block
                release()

        for batch in batches:
            for part in slices(batch):
                w = words_of(part.column("text"))
                if rows + part.num_rows > BLOCK_DOCS or tokens and tokens + len(w.hash) > block_tokens:
                    yield from flush()
                parts.append((part.column("key"), w))
                tokens, rows = tokens + len(w.hash) + part.num_rows, rows + part.num_rows
        yield from flush()

    # pair RDDs of one partitioner: their shuffle files serve all rounds, and unions of them need no shuffle
    dealt = source.mapInArrow(blocks, "bucket long, block long, kind string, data binary").rdd.map(lambda r: (r.bucket, (r.kind, r.block, bytes(r.data)))).partitionBy(buckets, int)

    def gathered(rows: Iterator, wanted: str = "") -> dict[str, list[tuple[int, bytes]]]:
        held: dict[str, list[tuple[int, bytes]]] = {}
        for _, (kind, who, data) in rows:
            if kind.startswith(wanted) or kind != "meta":
                held.setdefault(kind, []).append((who, data))
        return {kind: sorted(found) for kind, found in held.items()}

    def seated(rows: Iterator, turns: range) -> Iterator[Bucket]:
        """The bucket as it was after each of the turns, with the owners' answers."""
        held = gathered(rows, "pairs")
        if "pairs" in held:
            bucket = Bucket(held.pop("pairs"), splits, buckets, seed)
            if turns:
                bucket.answered(0, held.pop("answer0", []))
            for turn in turns:
                if turn:
                    bucket.t[bucket.c > 1] = unpack(held.pop(f"state{turn}")[0][1])[0]
                    bucket.answered(turn, held.pop(f"answer{turn}", []))
                yield bucket

    def sent(rows: Iterator, models: list[dict], turn: int) -> Iterator[tuple[int, tuple]]:
        me = TaskContext.get().partitionId()
        if not turn:
            held = gathered(rows, "pairs")
            found = [Bucket(held.pop("pairs"), splits, buckets, seed)] if "pairs" in held else []
        else:
            found = list(seated(rows, range(turn - 1, turn)))
        for bucket in found:
            if turn:
                bucket.sweep(models[turn - 1], turn)
                yield me, (f"state{turn}", me, pack(bucket.t[bucket.c > 1]))  # comes back with the answers
            yield from ((owner, (f"sums{turn}", me, data)) for owner, data in bucket.messages(turn))
        if found:
            del bucket, found
            release()

    def owned(rows: Iterator, models: list[dict], turn: int) -> Owner | None:
        held = gathered(row for row in rows if not row[1][0].startswith("state"))
        if "sums0" not in held:
            return None
        owner = Owner(held["sums0"], seed)
        for n in range(1, turn + 1):
            owner.later(held.get(f"sums{n}", []), models[n - 1], n)
        return owner

    models: list[dict] = []
    seats, sums = dealt, None
    for turn in range(rounds + 1):
        known = list(models)
        new = seats.mapPartitions(lambda rows, known=known, turn=turn: sent(rows, known, turn)).partitionBy(buckets, int)
        sums = new if sums is None else sums.union(new)

        def add(rows: Iterator, known: list[dict] = known, turn: int = turn) -> Iterator[np.ndarray]:
            owner = owned(rows, known, turn)
            if owner is not None:
                yield owner.scalars()

        def answer(rows: Iterator, known: list[dict] = known, turn: int = turn) -> Iterator[tuple[int, tuple]]:
            me, rows = TaskContext.get().partitionId(), list(rows)
            yield from ((me, (kind, who, data)) for _, (kind, who, data) in rows if kind == f"state{turn}")
            owner = owned(iter(rows), known, turn)
            if owner is not None:
                yield from ((bucket, (f"answer{turn}", me, data)) for bucket, data in owner.answers(turn))

        found = model_of(sums.mapPartitions(add).treeAggregate(np.zeros(8, np.int64), np.add, np.add, depth=2))
        models.append(found | ({k: models[0][k] for k in ("d1", "d2")} if models else {}))
        seats = seats.union(sums.mapPartitions(answer).partitionBy(buckets, int))

    def valued(rows: Iterator) -> Iterator[tuple[int, tuple]]:
        me, mean, bucket = TaskContext.get().partitionId(), 0.0, None
        for turn, bucket in zip(last := range(rounds - samples + 1, rounds + 1), seated(rows, last), strict=False):
            mean = mean + bucket.chances(models[turn])
        if bucket is None:
            return
        values, counts, at = np.log10(mean / samples).astype("<f4"), bucket.count[bucket.w], 0
        for block, n in bucket.blocks:
            place = bucket.place[at : at + n]
            at += n
            yield block % buckets, ("values", (block, me), pack(values[place], counts[place]))
        del bucket, mean, values
        release()

    def join(rows: Iterator) -> Iterator[tuple[bytes]]:
        metas, held = {}, {}
        for _, (kind, who, data) in rows:
            if kind == "meta":
                metas[who] = data
            elif kind == "values":
                held.setdefault(who[0], []).append((who[1], data))
        for block in sorted(metas):
            table, places = pickle.loads(metas.pop(block))
            table, (place,) = pa.ipc.open_stream(table).read_all(), unpack(places)
            parts = [unpack(data) for _, data in sorted(held.pop(block))]
            values, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            first = np.concatenate([[0], np.cumsum(table["n_tokens"].to_numpy())[:-1]])
            base = np.log10((counts.astype(float) + 1) / (models[0]["N"] + models[0]["V"] + 1))
            for name, v in (("base", base), ("own", values.astype(float)), ("known", (counts > 0).astype("i8"))):
                table = table.append_column(name, pa.array(np.add.reduceat(v[place], first)))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield (sink.getvalue().to_pybytes(),)
            release()

    train = models[0]["N"]
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("held_out", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                t = pa.ipc.open_stream(data).read_all().combine_chunks()
                columns = [t["key"], t["held_out"], t["n_tokens"], t["known"], pa.array(np.full(t.num_rows, train, dtype="i8")), t["base"], t["own"]]
                yield from pa.table(columns, names=schema.fieldNames()).to_batches()

    joined = dealt.union(seats.mapPartitions(valued).partitionBy(buckets, int)).mapPartitions(join)
    return spark.createDataFrame(joined, "data binary").mapInArrow(rows, schema)
