"""Operator 10: variable-capacity best-fit packing of documents into training sequences.

Documents are dealt to shards by a hash; each shard packs its own, longest first.  A piece
goes to the open bin that it fills best.  If it fits none, a bin is opened, of a capacity that
depends on the piece's class (the smallest permitted capacity that holds it).  Which capacity
each class opens is optimised jointly: the shard is packed under every single least capacity,
and from the cheapest of these choices classes are changed, one at a time, as long as the total
cost falls.  In the end every bin shrinks to the smallest permitted capacity that holds its
contents; its cost is a fixed overhead, its tokens' places, and their number squared over
`ATTENTION`, as attention over a sequence costs.

A document longer than the largest capacity is cut into pieces of that size and a rest;
nothing is dropped.  A null or negative length counts as 0, and a piece of length 0 still
has a place.  Null and empty texts have the end token alone; texts of any length are counted
whole.  Null and repeated keys are packed row by row; ties go by key.  An empty table gives an
empty table.  Columns beside key and length (or text) are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec
from .common import parts_for, ready
from .words import slices

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD, ATTENTION = 16, 65_536
#: Rounds of changes to the choice of capacities.
ROUNDS = 2


def cost(capacities: np.ndarray, overhead: float = OVERHEAD, attention: float = ATTENTION) -> np.ndarray:
    return overhead + capacities + capacities.astype(float) ** 2 / attention


def best_fit(sizes: Sequence[int], opens: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, sizes descending, and what each bin holds; `opens[n]`: the
    capacity of the bin that a piece of n tokens opens."""
    most = max(opens, default=0)
    room: list[list[int]] = [[] for _ in range(most + 1)]  # open bins by free space
    free = 0  # bit r is set if some open bin has r free
    bins, offsets, held = [], [], []
    for size in sizes:
        above = free >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, at = opens[size], len(held)
            held.append(0)
        bins.append(at)
        offsets.append(held[at])
        held[at] += size
        if r > size:
            room[r - size].append(at)
            free |= 1 << (r - size)
    return bins, offsets, held


def pack_jointly(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION, rounds: int = ROUNDS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, sizes descending, and the final capacity of each bin, for the
    cheapest choice found of the capacity that each class of pieces opens."""
    ladder = np.array(sorted(set(capacities)))
    of_size = np.searchsorted(ladder, np.arange(ladder[-1] + 1))  # class of each size
    known: dict[tuple[int, ...], tuple[float, tuple]] = {}
    used = sorted({int(of_size[n]) for n in sizes})

    def tried(choice: tuple[int, ...]) -> float:
        if choice not in known:
            bins, offsets, held = best_fit(sizes, ladder[np.array(choice)][of_size].tolist())
            final = ladder[np.searchsorted(ladder, held)] if held else np.zeros(0, np.int64)
            best = min((v[0] for v in known.values()), default=np.inf)
            total = float(cost(final, overhead, attention).sum())
            known[choice] = (total, (bins, offsets, final.tolist()) if total < best else ())
        return known[choice][0]

    best = min((tuple(max(i, j) for i in range(len(ladder))) for j in range(len(ladder))), key=lambda c: (tried(c), c))
    for _ in range(rounds):
        before = best
        for i in used:
            best = min((best[:i] + (j,) + best[i + 1 :] for j in range(i, len(ladder))), key=lambda c: (tried(c), c))
        if best == before:
            break
    if not known[best][1]:  # as cheap as another that was found before
        known.clear()
        tried(best)
    return known[best][1]


def pack(frame: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION, shards: int | None = None) -> DataFrame:
    """Key, piece, begin (first token of the piece in its document), n_tokens, bin_id, bin_offset, capacity."""
    ready(frame.sparkSession)
    capacities = sorted(capacities)
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be positive")
    source = frame.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    schema = T.StructType(
        [T.StructField(key, source.schema["key"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("piece", "begin", "n_tokens", "bin_id", "bin_offset", "capacity")]
    )
    count = shards or parts_for(frame, 64 << 20, 12)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths, most = rows["size"].to_numpy(), capacities[-1]
        pieces = np.maximum(1, -(-lengths // most))
        row = np.repeat(np.arange(len(lengths)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = piece * most
        size = np.minimum(most, lengths[row] - begin)
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[pc.sort_indices(rows, sort_keys=[("key", "ascending"), ("size", "ascending")]).to_numpy()] = np.arange(len(lengths))
        order = np.lexsort((piece, rank[row], -size))
        bins, offsets, final = pack_jointly(size[order].tolist(), capacities, overhead, attention)
        bins, base = np.array(bins, dtype=np.int64), TaskContext.get().partitionId() << 40
        columns = [rows["key"].combine_chunks().take(pa.array(row[order])), piece[order], begin[order], size[order], bins + base, np.array(offsets, dtype=np.int64), np.array(final, dtype=np.int64)[bins]]
        out = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype("i8")) for c in columns], schema.fieldNames())
        yield from (out.slice(a, 1 << 16) for a in range(0, out.num_rows, 1 << 16))

    return source.repartition(count, F.xxhash64("key", "size")).mapInArrow(work, schema)


def token_counts(frame: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Key and n_tokens: the ids of each whole text and one for its end, by a vocabulary file (by default the public byte-level one)."""
    ready(frame.sparkSession)
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    source = frame.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([source.schema.fields[0], T.StructField("n_tokens", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = codec(vocabulary, pattern, added=True).count
        for batch in batches:
            n = [count(x) + 1 if x else 1 for part in slices(batch) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64())], ["key", "n_tokens"])

    return source.mapInArrow(work, schema).withColumnRenamed("key", key)


def pack_documents(frame: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None, **options) -> DataFrame:
    """Pack documents by their token ids and one end token."""
    shards = options.pop("shards", None) or parts_for(frame, 64 << 20, 4)
    return pack(token_counts(frame, key, text, vocabulary, pattern), key, "n_tokens", shards=shards, **options)
