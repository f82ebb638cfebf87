"""Operator 1: byte-level BPE encoding and decoding of whole texts over Arrow batches.

Null and empty texts have no ids.  Rows are independent: repeated rows, repeated or null
keys and texts of any length are encoded as they come; an empty table gives an empty
table.  Only the key and the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec
from .common import ready

#: Bytes of text or ids that are held as one output batch.
BATCH_BYTES = 8 << 20


def runs(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `most` bytes."""
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def binary_sizes(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.binary_length(column).fill_null(0).cast(pa.int64()))


def encode(frame: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """Key and `ids`: the token ids as little-endian unsigned 32-bit integers (binary).  With
    `offsets`, `begins` and `ends` too: each token's first and one-past-last character."""
    ready(frame.sparkSession)
    source = frame.select(F.col(key), F.col(text).alias("__text"))
    fields = [source.schema.fields[0], T.StructField("ids", T.BinaryType())]
    if offsets:
        fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("begins", "ends")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            texts = batch.column(1)
            for a, b in runs(binary_sizes(texts)):
                ids = [coder.encode_bytes(t or "") for t in texts.slice(a, b - a).to_pylist()]
                columns = [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())]
                if offsets:
                    spans = [coder.offsets(np.frombuffer(i, "<u4")) for i in ids]
                    columns += [pa.array([s[k].astype("i4") for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(work, T.StructType(fields))


def decode(frame: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key, `ids` and `decoded`: the bytes that the ids stand for (null ids: none).  They are
    joined before they are read as UTF-8, so characters split over tokens come out whole."""
    ready(frame.sparkSession)
    source = frame.select(F.col(key), F.col(ids).alias("ids"))
    schema = T.StructType([source.schema.fields[0], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            for a, b in runs(binary_sizes(batch.column(1))):
                part = batch.slice(a, b - a)
                out = [coder.decode_bytes(np.frombuffer(i or b"", "<u4")) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], schema.fieldNames())

    return source.mapInArrow(work, schema)


def digests(frame: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Round trip of every text: key, n_tokens, ids_sha256 and decoded_sha256."""
    out = decode(encode(frame, vocabulary, pattern, key, text), vocabulary, pattern, key)
    return out.select(
        key,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
