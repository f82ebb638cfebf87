"""What the operators share: folders that all machines see, tables written there, sizes, memory."""

from __future__ import annotations

import atexit
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_folder, importable


def ready(spark: SparkSession) -> SparkSession:
    return importable(spark)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a local one only where none is set and all is one machine, as in tests."""
    folder = checkpoint_folder(spark)
    if "://" not in folder:  # a path on the cluster's default file system
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().replace("file:/", "file:///", 1)
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/lodestone-{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's file system layer."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone when the driver ends
        return


def written(frame: DataFrame, what: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: its lineage ends there, and lost executors take nothing along."""
    spark = frame.sparkSession
    path = scratch(spark, what)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _leaves(frame: DataFrame) -> list:
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [leaves.apply(i) for i in range(leaves.size())]


def input_bytes(frame: DataFrame) -> int:
    """Size of what a frame reads: of the files, by Catalyst's statistics; where those know no
    size (rows that come from no file), of the frame's own rows, added up by a job."""
    sizes = [int(leaf.stats().sizeInBytes()) for leaf in _leaves(frame)]
    if all(s < 1 << 60 for s in sizes):
        return sum(sizes)
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in frame.schema.fields]
    each = sum(wide[1:], wide[0]) if wide else F.lit(0)
    return frame.agg(F.sum(each.cast("long"))).first()[0] or 0


def replayable(frame: DataFrame) -> DataFrame:
    """A frame that gives the same rows in the same order whenever a task is repeated: itself if it
    only reads files, else a table written from it."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    narrow = all(leaf.nodeName() in ("LogicalRelation", "LocalRelation") or "Relation" in leaf.nodeName() for leaf in _leaves(frame))
    kinds = ("Project", "Filter")
    node = plan
    while narrow and node.children().size() == 1:
        narrow = node.nodeName() in kinds and node.deterministic()
        node = node.children().apply(0)
    return frame if narrow and node.children().size() == 0 else written(frame, "source")


def parts_for(frame: DataFrame, each: int = 32 << 20, least: int = 32) -> int:
    """Partitions so that each has about `each` bytes of what a frame reads."""
    return max(least, -(-input_bytes(frame) // each))


def release() -> None:
    """Give freed memory of a Python worker back to the machine; idle workers are kept for a while."""
    import gc

    gc.collect()
    trim()


def trim() -> None:
    """The same without a look for cycles, for the end of a task whose arrays are freed as they go."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as small as their values allow, byte by byte, compressed."""
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a):
            least = next((k for k in ("u1", "u2", "u4") if a.min() >= 0 and a.max() <= np.iinfo(k).max), None)
            a = a.astype(least) if least else a
        parts.append((a.dtype.str, np.ascontiguousarray(a.view("u1").reshape(len(a), -1).T).tobytes() if len(a) else b""))
    data = pickle.dumps(parts)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    parts = pickle.loads(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))
    return [np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() for kind, raw in parts]
