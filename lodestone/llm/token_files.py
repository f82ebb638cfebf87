"""Operator 6: token ids as flat files of unsigned integers with 64-bit document offsets.

A shard is three files in a folder that all machines see:

    shard-N.bin   the ids of its documents, one after another, 16 or 32 bits each
    shard-N.idx   n + 1 little-endian 64-bit offsets, counted over all shards
    shard-N.key   the documents' keys, signed 64 bits

Shards follow the ascending key.  A first pass over the range-partitioned documents
writes ids and counts; prefix sums over the shards' totals give each its base, and a
second pass over the small counts writes the offsets.  A task writes under a name of its
own and renames, so a repeated or lost task leaves whole files only.

Null and empty texts hold the end id alone; null keys come first (and are read back as
null); repeated keys stand in the order of their texts; an empty table writes no shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import parts_for, ready, scratch, written
from .tokenize import BATCH_BYTES, binary_sizes, runs

#: Key that stands for null in shard-N.key.
NULL_KEY = np.iinfo(np.int64).min


class Store:
    """Files of one folder, given by a URI: on a local or mounted disk by the operating
    system (reads are memory-mapped), else by pyarrow's file systems."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.local = isinstance(self.system, fs.LocalFileSystem)
        self.system.create_dir(self.root, recursive=True)

    def writer(self, name: str):
        return self.system.open_output_stream(f"{self.root}/{name}")

    def put(self, name: str, data: bytes) -> None:
        own = f"{name}.{uuid.uuid4().hex}"
        with self.writer(own) as out:
            out.write(data)
        self.rename(own, name)

    def rename(self, old: str, new: str) -> None:
        self.system.move(f"{self.root}/{old}", f"{self.root}/{new}")

    def array(self, name: str, dtype: str) -> np.ndarray:
        path = f"{self.root}/{name}"
        if self.system.get_file_info(path).size == 0:
            return np.zeros(0, dtype)
        if self.local:
            return np.memmap(path, dtype=dtype, mode="r")
        with self.system.open_input_file(path) as data:
            return np.frombuffer(data.read_buffer(), dtype=dtype)


def write(frame: DataFrame, folder: str, vocabulary: str, pattern: str, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_bytes: int = 24 << 20) -> DataFrame:
    """Encode every text, append `end_id`, write the shards in `folder`.  Returns the shards:
    shard, n_docs, n_tokens, base (ids in all shards before it)."""
    spark = ready(frame.sparkSession)
    source = frame.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = parts_for(source, shard_bytes, 6)
    ordered = source.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, store, coder = TaskContext.get().partitionId(), Store(folder), codec(vocabulary, pattern, added=True)
        kind = "<u2" if coder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        own = f"shard-{shard:08d}.{uuid.uuid4().hex}"
        keys, counts, out, end = [], [], None, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = out or store.writer(own)
            for a, b in runs(binary_sizes(batch.column("text"))):
                ids = [coder.encode_bytes(t or "") + end for t in batch.column("text").slice(a, b - a).to_pylist()]
                counts.append(np.array([len(i) // 4 for i in ids], "<i8"))
                keys.append(batch.column("key").slice(a, b - a).fill_null(int(NULL_KEY)).to_numpy())
                out.write(np.frombuffer(b"".join(ids), "<u4").astype(kind).tobytes())
        if out is None:
            return
        out.close()
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        store.put(f"shard-{shard:08d}.key", keys.astype("<i8").tobytes())
        store.put(f"shard-{shard:08d}.len", counts.tobytes())
        store.rename(own, f"shard-{shard:08d}.bin")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(counts)], "n_tokens": [int(counts.sum())], "bits": [int(kind[-1]) * 8]})

    shards = written(ordered.mapInArrow(encode, "shard long, n_docs long, n_tokens long, bits long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    based = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                counts = store.array(f"shard-{row['shard']:08d}.len", "<i8")
                offsets = row["base"] + np.concatenate([[0], np.cumsum(counts)])
                store.put(f"shard-{row['shard']:08d}.idx", offsets.astype("<i8").tobytes())
            yield batch

    spread = based.repartition(max(1, parts // 8), "shard")
    return written(spread.mapInArrow(index, based.schema), "shards-based")


def read(shards: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Documents of the shards from their files: key, start, n_tokens and `ids` (little-endian unsigned 32-bit, binary)."""
    ready(shards.sparkSession)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"shard-{row['shard']:08d}"
                ids, offsets = store.array(f"{name}.bin", f"<u{row['bits'] // 8}"), np.asarray(store.array(f"{name}.idx", "<i8"))
                keys = np.asarray(store.array(f"{name}.key", "<i8"))
                for a, b in runs(4 * np.diff(offsets), BATCH_BYTES):
                    at = offsets[a : b + 1] - offsets[0]
                    data = ids[at[0] : at[-1]].astype("<u4").tobytes()
                    blobs = [data[4 * x : 4 * y] for x, y in zip(at - at[0], at[1:] - at[0], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a:b], mask=keys[a:b] == NULL_KEY), pa.array(offsets[a:b]), pa.array(np.diff(at)), pa.array(blobs, pa.binary())],
                        [key, "start", "n_tokens", "ids"],
                    )

    each = shards.repartition(max(1, shards.count()), "shard")
    return each.mapInArrow(load, f"`{key}` long, start long, n_tokens long, ids binary")


def round_trip(frame: DataFrame, vocabulary: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Write the documents as files in the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = frame.sparkSession
    folder = scratch(spark, "token-files")
    out = read(write(frame, folder, vocabulary, pattern, end_id), folder)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
