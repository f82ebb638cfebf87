"""Operator 12: packing whose sequences follow a target mixture of sources, by deficit round-robin.

Each source is a queue of documents.  In every round a source earns its target share of a
window of tokens and is served as long as what it has earned covers the next piece (a
document, or up to `GRAIN` tokens of a longer one); what it could not spend it keeps as its
deficit for the next round.  Windows are cut from the tokens as they are served, so at any
point a source is ahead of or behind its share by little more than a piece and a round.

Documents are dealt to parts by a hash of their place in the files, so every part holds each
source's share, however large one source is, and parts are packed in tasks of their own.
Deficits pass from part to part: what the parts before could not serve of a source, as they held
less of it than its part of the corpus, follows from prefix sums over the parts' totals, without packing
one after another.  By default the targets are the sources' shares of all tokens; others may be
given.  A source that has run dry leaves its share to the rest of its part; one without a
target comes last there.

Every id lies in exactly one piece.  What a part has left beyond its last whole window is cut
at powers of two, so no sequence needs padding.

Null and empty texts have the end id alone.  Null sources are one queue.  Documents are told
apart by row, so repeated rows and repeated or null keys are packed row by row; ties of a
round go by the sources' names, null first, then by place.  Texts of any length are read
whole and cut.  An empty table gives an empty one.  Only key, text and source are read, so no
other column can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts_for, ready, replayable, written
from .tokenize import binary_sizes
from .word_bpe import word_codec
from .words import slices

WINDOW, GRAIN, END_ID = 2048, 512, 1
#: Bytes of input for each part.
PART_BYTES = 16 << 20


def encoded(frame: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", source: str = "source", end_id: int = END_ID) -> DataFrame:
    """row, key, source, n and ids (binary, as the vocabulary's codec stores them) of every text and its end id."""
    rows = replayable(frame.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "key", "source", "text")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_codec(vocabulary)
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            for part in slices(batch):
                ids = pa.array([x + end for x in coder.encode_texts(part.column("text").to_pylist())], pa.binary())
                n = pa.array(binary_sizes(ids) // len(end), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], n, ids], schema.fieldNames())

    return rows.mapInArrow(work, schema)


def rounds_of(ends: np.ndarray, deficit: np.ndarray, quantum: np.ndarray) -> np.ndarray:
    """The round in which each piece is served: the first in which what its queue is owed at the start and has
    earned since covers the queue up to the piece's end.  Queues that earn nothing come after all rounds."""
    earns = quantum > 0
    after = np.where(earns, (ends - deficit) / np.where(earns, quantum, 1), 0)
    rounds = np.maximum(np.ceil(after - 1e-9), 1)
    return np.where(earns, rounds, rounds.max(initial=0) + 1)


def boundaries(total: int, window: int) -> np.ndarray:
    """Ends of the sequences of a part: whole windows, then powers of two."""
    whole, rest = divmod(total, window)
    powers = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    return np.cumsum([window] * whole + powers)


def serve(queue: np.ndarray, sizes: np.ndarray, deficit: np.ndarray, quantum: np.ndarray, window: int = WINDOW, grain: int = GRAIN) -> tuple[np.ndarray, ...]:
    """Document, first token in it, length, sequence and offset there of each piece of a part.  Documents
    stand in the order of their queues (numbers into `deficit` and `quantum`), each with at least one token."""
    count = -(-sizes // grain)
    doc = np.repeat(np.arange(len(sizes)), count)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * grain
    length = np.minimum(grain, sizes[doc] - begin)
    of = queue[doc]
    order = np.lexsort((np.arange(len(doc)), of))
    run = np.cumsum(length[order])
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    run -= np.repeat(run[first] - length[order][first], np.diff(np.append(first, len(run))))
    ends = np.empty_like(run)
    ends[order] = run  # tokens of its queue up to each piece's end
    turn = np.lexsort((np.arange(len(doc)), of, rounds_of(ends, deficit[of], quantum[of])))
    until = np.cumsum(length[turn])
    edges = boundaries(int(until[-1]) if len(until) else 0, window)
    stops = np.union1d(until, edges)
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    at = np.searchsorted(until, starts, "right")
    piece = turn[at]
    token = begin[piece] + starts - (until - length[turn])[at]
    sequence = np.searchsorted(edges, starts, "right")
    # neighbours in a document and sequence are one piece
    new = np.ones(len(starts), bool)
    size = stops - starts
    new[1:] = (doc[piece][1:] != doc[piece][:-1]) | (sequence[1:] != sequence[:-1]) | (token[1:] != token[:-1] + size[:-1])
    head = np.flatnonzero(new)
    opened = np.concatenate([[0], edges]).astype(np.int64)
    return doc[piece][head], token[head], np.add.reduceat(size, head) if len(head) else size, sequence[head], starts[head] - opened[sequence[head]]


def owed(totals: DataFrame, targets: Mapping[str | None, float] | None = None) -> DataFrame:
    """part, source, share, deficit, from the totals (part, source, n).  share: the source's target.  deficit: how many tokens fewer
    (below 0: more) the parts before held of the source than its part of the corpus, which they could not serve."""
    spark = totals.sparkSession
    held = totals.groupBy("source").agg(F.sum("n").cast("double").alias("held"))
    if targets is None:
        share = held.withColumn("w", F.col("held"))
    else:
        if any(w < 0 for w in targets.values()):
            raise ValueError("targets must not be negative")
        given = spark.createDataFrame([(k, float(w)) for k, w in targets.items()], "target string, w double")
        share = held.join(given, F.col("source").eqNullSafe(F.col("target")), "left").select("source", "held", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = share.agg(F.sum("held").alias("all_held"), F.sum("w").alias("all_w"))  # one row
    part_of = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    share = share.join(F.broadcast(sums)).select(F.col("source").alias("__s"), part_of("w", "all_w").alias("share"), part_of("held", "all_held").alias("usual"))
    every = totals.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each part
    before = every.select(F.col("part").alias("__p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("all_before"))
    served = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    each = totals.withColumn("served", served).join(before, F.col("part") == F.col("__p")).join(share, F.col("source").eqNullSafe(F.col("__s")))
    return each.select("part", "source", "share", (F.col("usual") * F.col("all_before") - F.col("served")).alias("deficit"))


def pack_mixture(
    frame: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", source: str = "source", window: int = WINDOW, grain: int = GRAIN, end_id: int = END_ID,
    targets: Mapping[str | None, float] | None = None, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Key, source, start (first token of the piece in its document), length, ids_crc32 (of its ids as little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id (ascending with the windows, part after part) and offset (in the sequence) of every piece."""
    if window < 1 or grain < 1:
        raise ValueError("window and grain must be positive")
    ready(frame.sparkSession)
    parts = parts_for(frame, part_bytes, 6)
    docs = written(encoded(frame, vocabulary, key, text, source, end_id), "tokens").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    totals = written(docs.groupBy("part", "source").agg(F.sum("n").alias("n")), "totals")
    schema = T.StructType(
        [T.StructField(key, docs.schema["key"].dataType), T.StructField("source", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def work(rows: pa.Table, shares: pa.Table) -> pa.Table:
        kind = word_codec(vocabulary).dtype
        rows = rows.take(pc.sort_indices(rows["row"]))
        names = sorted(shares["source"].to_pylist(), key=lambda x: (x is not None, x or ""))
        place = {name: i for i, name in enumerate(names)}
        share, deficit = np.zeros(len(names)), np.zeros(len(names))
        for name, s, d in zip(*(shares[c].to_pylist() for c in ("source", "share", "deficit")), strict=True):
            share[place[name]], deficit[place[name]] = s, d
        coded = rows["source"].combine_chunks().dictionary_encode("encode")
        queue = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        sizes = rows["n"].to_numpy().astype(np.int64)
        doc, start, length, sequence, offset = serve(queue, sizes, deficit, share * window, window, grain)
        ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), kind).astype("<u4")
        data, first = memoryview(ids.tobytes()), np.cumsum(sizes) - sizes
        begins = (first[doc] + start) * 4
        crc = [zlib.crc32(data[a:b]) for a, b in zip(begins.tolist(), (begins + length * 4).tolist(), strict=True)]
        part = rows["part"][0].as_py()
        columns = [start, length, crc, sizes[doc], sequence + (part << 32), offset]
        return pa.table([rows["key"].take(pa.array(doc)), rows["source"].take(pa.array(doc)), *(pa.array(np.asarray(c, dtype=np.int64)) for c in columns)], schema.fieldNames())

    return docs.groupBy("part").cogroup(owed(totals, targets).groupBy("part")).applyInArrow(work, schema)
