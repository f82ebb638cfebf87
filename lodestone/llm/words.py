"""Words of whole texts as 64-bit hashes, by vectorised passes over Arrow's byte buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.  Bytes of
longer UTF-8 sequences are never below 0x80, so the runs are those of the characters.
Two different words share a hash with a probability below 2**-56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240601))
_WEIGHTS = _RANDOM.integers(0, 2**64, size=4096, dtype=np.uint64)

END = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits well."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(longest: int) -> np.ndarray:
    global _WEIGHTS
    if longest > len(_WEIGHTS):
        generator = np.random.Generator(np.random.PCG64(20240602))
        _WEIGHTS = np.concatenate([_WEIGHTS[:4096], generator.integers(0, 2**64, size=2 * longest, dtype=np.uint64)])
    return _WEIGHTS


class Words:
    """Words of consecutive rows: `hash` of each, `first[i]:first[i + 1]` those of row i."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.hash, self.first = hashes, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: pa.Array) -> Words:
    """Words of an array of strings; null counts as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts) or bounds[-1] == bounds[0]:
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    solid = ~_BLANK[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[bounds < len(raw)]
    begins[inner] = solid[inner]  # a row begins a word of its own
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    kept = np.flatnonzero(solid)
    order = np.cumsum(solid)[starts] - 1  # of each word's first byte among the kept bytes
    sizes = np.diff(np.append(order, len(kept)))
    place = np.arange(len(kept)) - np.repeat(order, sizes)
    weights = _weights(int(sizes.max()))
    low = _LOWER[raw[kept]].astype(np.uint64)
    sums = np.add.reduceat((low + np.uint64(1)) * weights[place], order)
    return Words(mix(sums + mix(sizes.astype(np.uint64))), np.searchsorted(starts, bounds))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each."""
    texts = batch.column(column)
    sizes = np.asarray(pc.binary_length(texts).fill_null(0).cast(pa.int64()))
    group = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def shingles(words: Words, size: int) -> Words:
    """Hashes of each row's runs of `size` words; a row with fewer words has them all as one, without words none."""
    counts = words.counts
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], made)
    held = np.repeat(np.minimum(counts, size), made)
    sums = mix(held.astype(np.uint64))
    for k in range(size):
        inside = held > k
        nxt = words.hash[np.where(inside, at + k, at)] if len(at) else np.zeros(0, np.uint64)
        sums = np.where(inside, mix(sums * np.uint64(0xD6E8FEB86659FD93) + nxt), sums)
    return Words(sums, first)
