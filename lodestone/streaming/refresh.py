"""An index that grows with a stream: every batch adds its counted documents and a delta of the corpus counts.

Below the index's folder a batch N writes

    ids/bucket=B/batch=N    its keys, dealt to buckets by hash
    counted/batch=N         its documents with their counted terms
    deltas/batch=N          its corpus counts; they are written last and make the batch count

A batch that is repeated after a failure writes the same folders again, so it counts once.  Documents
whose key an earlier batch brought are left out; for that only the buckets that hold a key of the
batch are read.  Terms and statistics follow from the sum of the deltas, whatever their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sparse

BUCKETS = 256


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def batches(spark: SparkSession, path: str) -> list[int]:
    """The batches that count: those whose deltas are whole."""
    system, at = _path(spark, f"{path}/deltas")
    if not system.exists(at):
        return []
    done = system.globStatus(_path(spark, f"{path}/deltas/batch=*/_SUCCESS")[1])
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in done)


def add_batch(batch: DataFrame, number: int, path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> None:
    """Take a batch of documents into the index; null keys are one key."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    fresh = batch.dropDuplicates([key]).withColumn("bucket", bucket)
    earlier = [n for n in batches(spark, path) if n != number]
    if earlier:
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
        known = spark.read.option("basePath", f"{path}/ids").parquet(f"{path}/ids").filter(F.col("bucket").isin(touched) & F.col("batch").isin(earlier))
        fresh = fresh.join(known.select(F.col("doc_id").alias("__known")), F.col(key).eqNullSafe(F.col("__known")), "left_anti")
    counted = f"{path}/counted/batch={number}"
    sparse.counted_documents(fresh, key, text).write.mode("overwrite").parquet(counted)
    counted = spark.read.parquet(counted)
    keys = counted.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(number).alias("batch"))
    keys.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{path}/ids")
    sparse.corpus_counts(counted).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")


def live_index(spark: SparkSession, path: str) -> sparse.SparseIndex:
    """The index of all batches that count."""
    done = batches(spark, path)
    if not done:
        raise FileNotFoundError(f"{path} holds no batch")
    read = lambda name: spark.read.parquet(*[f"{path}/{name}/batch={n}" for n in done])
    return sparse.from_counts(read("counted"), sparse.merged_counts(read("deltas")))


def refresh_index(documents: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Documents of a stream join the index below `path` batch by batch; `live_index` reads it."""

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, path, key, text)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Logged runs as a stream of query_id, answer, grounded."""
    lines = spark.readStream.text(path)
    return lines.select(F.from_json("value", "query_id string, answer string, grounded boolean").alias("r")).select("r.*")
