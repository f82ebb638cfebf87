"""Operator 13: importance resampling towards a target distribution, by hashed n-grams from position tables.

A text's words (A-Z lower-cased) are exploded with their positions, and a window over each
document reads the following words, so that every position has its run of 1, 2 and 3 words.
Each run is hashed to a bucket; the buckets' counts in the raw and in the target texts give
each its gain, and the gains, joined to the buckets, add up to a document's weight.  With
Gumbel noise drawn from a hash of the key, the highest scores are a sample without
replacement in proportion to exp(weight / 1000).

Documents are told apart by their place in the files, not by key: repeated rows and repeated
or null keys (whose noise is that of an empty key) count and compete row by row.  Null and
empty texts, and texts without a word, have no features and weight 0.  Ties go to the smaller
key, a null one first.  An empty table gives an empty one; with empty target texts all target
counts are 0.  Texts of any length are read whole: a document's words are one window.
Columns beside key and text are not read, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import positions
from .common import parts_for, ready, replayable, written

#: Buckets of features, longest run of words, share of the documents to draw in hundredths, fewest words of a drawn one.
BUCKETS, ORDERS, PERCENT, LEAST_WORDS = 10_000, 3, 5, 20
SEED = 42
#: Bytes of input in a partition of the position table.
PART_BYTES = 8 << 20
#: A-Z, and the characters that stand between words.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """The words, and empty strings where no word stands beside a separator."""
    return F.split(F.translate(text, UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN)), " ")


def position_table(frame: DataFrame, text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The frame's other columns with `b1` to `bn`: the buckets of the runs that begin at each word (null past the
    end).  `row` tells documents apart.  Whole texts are dealt by row, so the exploded words need no shuffle."""
    dealt = frame.repartition(parts_for(frame, part_bytes, 4), "row")
    each = dealt.select(*[c for c in frame.columns if c != text], F.posexplode(words(F.col(text))).alias("at", "w1")).filter("w1 <> ''")
    place = Window.partitionBy("row").orderBy("at")
    each = each.withColumns({f"w{i + 1}": F.lead("w1", i).over(place) for i in range(1, orders)})
    bucket = lambda *c: F.pmod(F.crc32(F.concat(*c).cast("binary")), F.lit(buckets)).cast("int")
    runs = [[x for i in range(n) for x in (F.lit(" "), F.col(f"w{i + 1}"))][1:] for n in range(1, orders + 1)]
    return each.select(*[c for c in frame.columns if c != text], *[bucket(*run).alias(f"b{n}") for n, run in enumerate(runs, 1)])


def _exploded(table: DataFrame, orders: int) -> DataFrame:
    kept = [c for c in table.columns if c not in {f"b{n}" for n in range(1, orders + 1)}]
    return table.select(*kept, F.explode(F.array(*[f"b{n}" for n in range(1, orders + 1)])).alias("bucket")).filter("bucket IS NOT NULL")


def bucket_counts(table: DataFrame, orders: int = ORDERS) -> DataFrame:
    """bucket and its number of features n."""
    return _exploded(table, orders).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of all buckets, from the counts (bucket, n) of the raw and of the target texts."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = counted.agg(F.sum("s").alias("raw"), F.sum("t").alias("target"))  # one row
    double = lambda c: F.col(c).cast("double")
    ratio = ((double("t") + 1) * (double("raw") + buckets)) / ((double("s") + 1) * (double("target") + buckets))
    return counted.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, by a hash of the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    frame: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Key, n_features, weight, score and rank (from 1, null if not drawn) of every document."""
    ready(frame.sparkSession)
    numbered = lambda f, *c: replayable(f.select(*c)).withColumn("row", F.monotonically_increasing_id())
    docs = numbered(frame, F.col(key).alias("key"), F.col(text).alias("text"))
    table = written(position_table(docs.select("row", "text"), buckets=buckets, orders=orders, part_bytes=part_bytes), "buckets")  # read twice
    wanted = position_table(numbered(target, F.col(target_text).alias("text")), buckets=buckets, orders=orders, part_bytes=part_bytes)
    gains = written(bucket_gains(bucket_counts(table, orders), bucket_counts(wanted, orders), buckets), "gains")  # a row for each bucket
    weighed = _exploded(table, orders).join(F.broadcast(gains), "bucket").groupBy("row").agg(F.count("*").alias("n_features"), F.sum("gain").alias("weight"))
    scored = docs.select("row", "key").join(weighed, "row", "left").fillna(0, ["n_features", "weight"])
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col("key"), seed)), "scores")
    # n words have n + (n - 1) + ... features
    least = sum(max(0, least_words - i) for i in range(orders))
    able = scored.filter(F.col("n_features") >= least)
    drawn = able.agg(F.floor(F.count("*") * percent / 100).alias("drawn"))  # one row
    ranked = positions(able.select("row", "score", "key"), F.desc("score"), F.asc("key"), name="rank").join(F.broadcast(drawn)).filter("rank <= drawn")
    out = scored.join(ranked.select("row", "rank"), "row", "left")
    return out.select(F.col("key").alias(key), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def sql(buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> str:
    """The same over `documents` and `benchmark`; the checksum is worked out byte by byte for each distinct feature."""
    runs = lambda source, keyed: " UNION ALL ".join(
        f"SELECT {keyed}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM {source}" for n in (1, 2, 3)
    )
    cut = lambda x: rf"regexp_extract_all(translate(coalesce({x}, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, {cut("text")} AS w FROM documents), b AS (SELECT 0 AS row, {cut("text")} AS w FROM benchmark),
df AS ({runs("d", "row")}), bf AS ({runs("b", "row")}),
crc AS (SELECT {_TABLE} AS t),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST(CAST('0x' || substr(x, 2 * i + 1, 2) AS INTEGER) AS BIGINT))), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) % {buckets} AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS raw, coalesce((SELECT sum(t) FROM t), 0) AS target),
g AS (SELECT bucket, CAST(floor(1000 * ln(((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(raw AS DOUBLE) + {buckets})) / ((CAST(s AS DOUBLE) + 1) * (CAST(target AS DOUBLE) + {buckets})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
m AS (SELECT row, count(*) AS n, sum(gain) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY row),
c AS (SELECT doc_id, row, len(w) AS words, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) AS h FROM d LEFT JOIN m USING (row)),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM c),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM e WHERE words >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {percent} // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (row)"""


SQL = sql()
