"""Places in a global order, and digests that depend on it, without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Bits that monotonically_increasing_id() keeps for a row's place in its partition.
PLACE_BITS = 33
#: The lanes of the ordered digest: polynomials modulo a Mersenne prime, one for each base.
PRIME = (1 << 61) - 1
BASES = (1_099_511_628_211, 1_000_000_007_000_003, 2_305_843_009_213_693_921, 314_159_265_358_979_323)


def ranges(frame: DataFrame, *order: Column, partitions: int | None = None) -> DataFrame:
    """The rows in range partitions, each sorted: partition after partition they are in order."""
    return frame.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)


def positions(frame: DataFrame, *order: Column, name: str = "position", partitions: int | None = None) -> DataFrame:
    """The frame with each row's place in the order, from 1.

    A row's place is its place within its range partition and the rows of all partitions before
    that.  The ordered rows are stored first: range bounds come from a sample, so a replayed
    task could cut elsewhere.  Only one row for each partition is summed up and broadcast.
    Rows that tie in the whole order get places in some order; an empty frame stays empty.
    """
    placed = stored(ranges(frame, *order, partitions=partitions).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", PLACE_BITS))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return placed.join(F.broadcast(before), "__part").select(*frame.columns, place.alias(name))


def ordered_digest(frame: DataFrame, digest: str, *order: Column, partitions: int | None = None) -> DataFrame:
    """One row, `fingerprint`: a digest of the rows' hexadecimal digests in their order.

    Each lane is the polynomial  sum d(i) * base ** (n - i)  modulo a prime: partitions give theirs with the
    power for their length, and these are combined in the partitions' order, so rows may be
    cut anywhere, but none may change places.  Without rows all lanes are zero.
    """
    lanes = range(len(BASES))
    schema = "at int, n long, " + ", ".join(f"h{i} decimal(38,0), p{i} decimal(38,0)" for i in lanes)
    whole = pa.decimal128(38, 0)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        at, n, held = 0, 0, [0] * len(BASES)
        for batch in batches:
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = part, n + 1
                held = [(h * b + int(value[15 * i : 15 * i + 15], 16)) % PRIME for i, (h, b) in enumerate(zip(held, BASES, strict=True))]
        if n:
            columns = [pa.array([at], pa.int32()), pa.array([n], pa.int64())]
            for h, b in zip(held, BASES, strict=True):
                columns += [pa.array([Decimal(h)], whole), pa.array([Decimal(pow(b, n, PRIME))], whole)]
            yield pa.RecordBatch.from_arrays(columns, ["at", "n", *[f"{x}{i}" for i in lanes for x in "hp"]])

    ordered = ranges(frame.withColumn("__digest", F.col(digest)), *order, partitions=partitions)
    parts = ordered.select(F.spark_partition_id().alias("at"), "__digest").mapInArrow(fold, schema)
    each = parts.agg(F.sort_array(F.collect_list(F.struct("at", "n", *[f"{x}{i}" for i in lanes for x in "hp"]))).alias("a"))  # a row for each partition
    decimal = lambda c: c.cast("decimal(38,0)")

    def folded(i: int) -> Column:
        return F.aggregate("a", decimal(F.lit(0)), lambda h, x: decimal((h * x[f"p{i}"] + x[f"h{i}"]) % F.lit(PRIME)))

    count = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return each.select(F.sha2(F.concat_ws(":", count.cast("string"), *[folded(i).cast("string") for i in lanes]).cast("binary"), 256).alias("fingerprint"))
