"""Connected components of a table of links by alternating large and small stars.

Each round rewires every node's larger neighbours, then its smaller ones, to the smallest
node it knows; the rounds end when nothing changes, after about the logarithm of the longest
path.  Every round is written to the shared folder, and the one before removed, so lineage stays short.  Minima are
pre-aggregated before the shuffle, so a node with very many links is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stored(links: DataFrame) -> tuple[DataFrame, str]:
    path = scratch(links.sparkSession, "links")
    links.write.parquet(path)
    return links.sparkSession.read.schema(links.schema).parquet(path), path


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node of its component) of every node that has a link."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now, path = _stored(pairs)
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        before = path
        now, path = _stored(small.filter("u > v").distinct())
        remove(links.sparkSession, before)  # nothing reads that round any more
        last, mark = mark, _mark(now)
        if mark == last:
            break
    # every node now hangs on its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
