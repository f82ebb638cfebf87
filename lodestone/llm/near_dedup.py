"""Operator 8: near-duplicates by fast similarity sketches, banding and exact verification.

1.  Each text's set of word shingles gets a sketch.  In round i every element is thrown into
    one bin, and a bin keeps the least value of the first round that reached it; in the
    rounds after the t-th each round fills one bin with the least value of all elements, so
    after 2t rounds every bin of any set is full.
2.  Texts with the same set are one class from here on: copies are never compared.
3.  Each band's classes are compared exactly with the smallest of them: distinct pairs (class,
    smallest), so one for each class and band, not all pairs.  The number of bands follows
    from the threshold: a pair at the threshold shares none with a probability below `MISS`.
4.  Where those links leave the classes of a band in several parts, classes of different parts
    are compared exactly, in memory, by bit sets of the shingles that occur twice or more; only
    links that join two parts are put out.  A group of more than `BLOCK` classes is cut into
    blocks, and pairs of blocks are tasks.  Large groups of near copies are one part by then.
5.  Components of the verified links give each document its component.

Null and empty texts have no shingles and are linked with nothing; rows without key take no
part and are kept, with a null component.  Texts of any length are compared whole.  Repeated
rows, and rows that share a key, are each classed by their text.  Ties go to the smaller key.
An empty table gives an empty table.  Only key and text are read; columns named as the
operator's own stay as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, release, written
from .components import components
from .words import Words, mix, shingles, slices, words_of

ROWS, MISS, BLOCK = 6, 1e-6, 1500
#: Shingles that are sketched at once.
AT_ONCE = 1 << 18


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found: Words = shingles(words_of(texts), size)
    return [np.unique(found.hash[a:b]) for a, b in zip(found.first, found.first[1:], strict=False)]


def node_of(shingle_set: np.ndarray) -> int:
    """Class of the texts with this set."""
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """t coordinates of each set that isn't empty."""
    sizes = np.array([len(s) for s in sets])
    value = np.full(len(sets) * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    low = np.uint64((1 << 48) - 1)
    done, step = 0, 1
    while len(element):
        rounds = np.arange(done, min(done + step, t if done < t else 2 * t), dtype=np.uint64)
        h = mix((element[None, :] ^ mix(rounds + np.uint64(1))[:, None]).ravel())
        if done < t:
            slot = (h >> np.uint64(40)) % np.uint64(t)
        else:
            slot = np.repeat(rounds - np.uint64(t), len(element))
        at = np.tile(owner, len(rounds)) * t + slot.astype(np.int64)
        np.minimum.at(value, at, np.repeat(rounds, len(element)) << np.uint64(48) | h * np.uint64(0x9E3779B97F4A7C15) & low)
        done += len(rounds)
        open_ = (value.reshape(len(sets), t) == np.iinfo(np.uint64).max).any(axis=1)
        still = open_[owner]
        element, owner = element[still], owner[still]
        step = max(1, min(64, AT_ONCE // max(1, len(element)))) if done >= 4 else 1
        if done >= 2 * t:
            break
    return value.reshape(len(sets), t)


def sketches(frame: DataFrame, size: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """id, text_hash, n_shingles, node (null without shingles), bands."""
    ready(frame.sparkSession)
    source = frame.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    names = ["id", "text_hash", "n_shingles", "node", "bands"]

    def out(ids: list, marks: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        hashes = np.zeros((0, bands), dtype=np.int64)
        if full:
            s = sketch(full, bands * rows).reshape(len(full), bands, rows)
            h = np.tile(mix(np.arange(bands, dtype=np.uint64) + np.uint64(17)), (len(full), 1))
            for r in range(rows):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) ^ s[:, :, r])
            hashes = h.view(np.int64)
        lists, nodes, at = [], [], 0
        for s in sets:
            nodes.append(node_of(s) if len(s) else None)
            lists.append(hashes[at] if len(s) else np.zeros(0, np.int64))
            at += len(s) > 0
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, sets, held = [], [], [], 0
            for part in slices(batch):
                sets += (new := sets_of(part.column("text"), size))
                ids += part.column("id").to_pylist()
                marks += part.column("text_hash").to_pylist()
                held += sum(map(len, new))
                if held >= AT_ONCE:
                    yield out(ids, marks, sets)
                    ids, marks, sets, held = [], [], [], 0
            if ids:
                yield out(ids, marks, sets)
            del ids, marks, sets
            release()

    return source.mapInArrow(work, "id long, text_hash long, n_shingles long, node long, bands array<long>")


def links_within(labels: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places of linked left and right sets that join parts not joined before; sets of one label are one part."""
    sizes = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    shared = np.diff(np.append(np.flatnonzero(new), len(flat))) > 1
    number = np.cumsum(new) - 1
    use = shared[number]
    column, row = (np.cumsum(shared) - 1)[number[use]], row[use]
    width = -(-int(shared.sum()) // 64) or 1
    bits = np.zeros((len(sets), width), dtype=np.uint64)
    np.bitwise_or.at(bits, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    # sets of one block are ordered by size: only a range can reach the threshold
    right = right[np.argsort(sizes[right], kind="stable")]
    ordered = sizes[right]
    part, out = np.unique(labels, return_inverse=True)[1], []
    for a in left:
        lo = np.searchsorted(ordered, -(-sizes[a] * percent // 100), "left")
        hi = np.searchsorted(ordered, sizes[a] * 100 // percent, "right")
        others = right[lo:hi]
        others = others[part[others] != part[a]]
        if not len(others):
            continue
        both = np.bitwise_count(bits[others] & bits[a]).sum(axis=1, dtype=np.int64)
        linked = others[100 * both >= percent * (sizes[others] + sizes[a] - both)]
        parts, first = np.unique(part[linked], return_index=True)
        if len(parts):
            out += [(int(a), int(linked[i])) for i in first]
            part[np.isin(part, parts)] = part[a]
    return out


def shingles_of(frame: DataFrame, wanted: DataFrame, sketched: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """node and shingles (packed 64-bit hashes) of the wanted nodes."""
    first = sketched.filter("node IS NOT NULL AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"))
    first = first.join(wanted.select("node").distinct(), "node").select("id", F.col("node").alias("wanted"))
    texts = frame.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, nodes = sets_of(part.column("text"), size), part.column("wanted").to_pylist()
                own = [len(s) > 0 and node_of(s) == n for s, n in zip(sets, nodes, strict=True)]  # ids may repeat
                blobs = pa.array([s.tobytes() for s, o in zip(sets, own, strict=True) if o], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("wanted").filter(pa.array(own)), blobs], ["node", "shingles"])

    return texts.join(first, "id").mapInArrow(gather, "node long, shingles binary").dropDuplicates(["node"])


def _sets(table: pa.Table, at: np.ndarray) -> list[np.ndarray]:
    column = table["shingles"]
    return [np.frombuffer(column[int(k)].as_py(), np.uint64) for k in at]


def star_links(stars: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links a, b of the pairs (node, centre) whose sets reach the threshold.  A centre's nodes are
    dealt to tasks of about `block`, each with the centre's set."""
    counts = stars.groupBy("centre").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = stars.join(counts, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    own = dealt.unionByName(counts.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    held = own.join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        nodes, centre = table["node"].to_numpy(), table["centre"][0].as_py()
        sets = _sets(table, np.arange(len(nodes)))
        middle = sets[int(np.flatnonzero(nodes == centre)[0])]
        found = []
        for node, other in zip(nodes.tolist(), sets, strict=True):
            both = len(np.intersect1d(middle, other, assume_unique=True)) if node != centre else 0
            if node != centre and 100 * both >= percent * (len(middle) + len(other) - both):
                found.append(node)
        return pa.table({"a": pa.array([centre] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return held.groupBy("centre", "block").applyInArrow(compare, "a long, b long")


def group_links(groups: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links a, b between labels of a group (root) of which nodes have sets that reach the threshold."""
    counts = groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = groups.join(counts, "root").join(sets, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table["node"].to_numpy(), return_index=True)
        own, labels = table["own"].to_numpy()[at], table["label"].to_numpy()[at]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        found = links_within(labels, _sets(table, at), np.flatnonzero(own == i), np.flatnonzero(own == j), percent)
        a, b = (labels[[pair[k] for pair in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.groupBy("root", "i", "j").applyInArrow(compare, "a long, b long")


def parts_of(frame: DataFrame, sketched: DataFrame, size: int, percent: int, key: str, text: str, block: int) -> DataFrame:
    """node and root of the classes that are linked: first those that the links of each band's
    nodes with its smallest make, then, where these leave a band's nodes in several parts, those
    of the links between the parts."""
    usable = sketched.filter("node IS NOT NULL AND id IS NOT NULL")
    banded = usable.dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    smallest = banded.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("last > centre").select("band", "centre")
    shared = written(banded.join(smallest, "band"), "bands")  # what occurs once is left behind
    stars = written(shared.filter("node <> centre").select("node", "centre").distinct(), "stars")
    wanted = stars.select("node").unionByName(stars.select(F.col("centre").alias("node")))
    sets = written(shingles_of(frame, wanted, sketched, size, key, text), "sets")
    parts = components(star_links(stars, sets, percent, block))
    labelled = shared.join(parts, "node", "left").select("node", "band", F.coalesce("root", "node").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("last")).filter("last > least").select("band", "least")
    rest = written(labelled.join(mixed, "band").select("node", "label", "least").distinct(), "mixed")
    groups = rest.select("node", "label").distinct().join(components(rest.filter("label <> least"), "label", "least").withColumnRenamed("node", "label"), "label")
    joined = components(group_links(groups, sets, percent, block)).select(F.col("node").alias("label"), F.col("root").alias("further"))
    every = shared.select("node").distinct().join(parts, "node", "left").withColumn("label", F.coalesce("root", "node"))
    return every.join(joined, "label", "left").select("node", F.coalesce("further", "label").alias("root"))


def classes(frame: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, key: str = "doc_id", text: str = "text", block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """Key, text_hash, n_shingles, node, root (of the component), component_id and kept of every document; documents are
    linked if 100 * intersection >= percent * union of their sets of `size`-word shingles.
    A pair at the threshold is missed with a probability of at most `miss`; with rows=1 and a
    miss of 1e-300 every pair that shares a least value is compared."""
    sketched = written(sketches(frame, size, bands_for(percent, rows, miss), rows, key, text), "sketches")
    usable = sketched.filter("node IS NOT NULL AND id IS NOT NULL")
    roots = written(parts_of(frame, sketched, size, percent, key, text, block), "roots")
    firsts = usable.groupBy("node").agg(F.min("id").alias("first"))
    # both are written first: a join of stored tables can be split where one component or class is hot
    smallest = written(roots.join(firsts, "node").groupBy("root").agg(F.min("first").alias("least")), "least")
    labelled = firsts.join(roots, "node", "left").join(smallest, "root", "left")
    labels = written(labelled.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("least", "first").alias("component_id")), "labels")
    out = sketched.join(labels, "node", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(key), "text_hash", "n_shingles", "node", "root", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep(frame: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest key (then hash of
    the text), its columns as they were.  Documents without words are in no group: of those only
    repeated rows (same key and text) go.  Rows that share a key are told apart by their texts.
    Rows without key stay.  An empty table gives an empty table."""
    columns = frame.columns
    found = written(classes(frame, size, percent, key=key, text=text).select(F.col(key).alias("__key"), F.col("text_hash").alias("__text"), "root"), "classes").filter("__key IS NOT NULL")
    winner = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("__key", "__text")).alias("w")).select("w.*")
    stays = winner.unionByName(found.filter("root IS NULL").select("__key", "__text").distinct())
    named = frame.withColumn("__key", F.col(key).cast("long")).withColumn("__text", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    single = named.join(stays, ["__key", "__text"], "left_semi").dropDuplicates(["__key", "__text"])
    return single.unionByName(named.filter("__key IS NULL")).select(*columns)


#: The classes of `documents` with 3-word shingles and 85 percent, by all pairs that share a shingle.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, seen) AS (
  SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen
), least AS (
  SELECT node, min(seen) AS m FROM reach GROUP BY node
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(l.m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least l ON l.node = w.doc_id
"""
