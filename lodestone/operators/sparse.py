"""BM25: postings, document statistics and batched top-k retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import query_tokens, text_or_empty, tokenize
from ..session import stored

#: The usual constants of the scoring formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms of all questions up to which they go to every task; found terms of a block of documents; what rounding may add to a score.
ASKED_TERMS, BLOCK_HITS, SLACK = 50_000, 200_000, 1e-8

#: Bytes of text whose tokens are counted at once.
TEXT_BYTES = 1 << 20
COUNTS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
#: Kinds of bytes: none of these is a part of a longer UTF-8 sequence.
CAPITAL, SMALL, DIGIT = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58] = CAPITAL, SMALL, DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunk_document(name: str = "function_name", docstring: str = "docstring", source: str = "source", filepath: str = "filepath") -> Column:
    """What of a chunk is indexed: its name, docstring, source and path, without empty ones."""
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in (name, docstring, source, filepath)])


@dataclass
class SparseIndex:
    """documents(doc_id, dl, counts: array of term and tf), a row each; terms(term, df, idf) and stats(n_docs, avg_len)."""

    documents: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """doc_id, term, tf, dl."""
        return self.documents.select("doc_id", "dl", F.inline("counts")).select("doc_id", "term", "tf", "dl")


def token_counts(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many tokens (see `tokenize`) each text has, and its terms with their counts, by term; null where there are none.

    All texts' bytes are worked on at once: a token begins behind what is neither letter nor digit, at a capital behind a
    small letter or digit, and at the last of several capitals if a small letter follows."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    kind = _KINDS[raw]
    before, behind = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)
    before[1:], behind[:-1] = kind[:-1], kind[1:]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    before[firsts] = 0  # texts end where the next begins
    behind[firsts[1:] - 1] = 0
    capital = kind == CAPITAL
    starts = np.flatnonzero(((kind > 0) & (before == 0)) | (capital & ((before > CAPITAL) | ((before == CAPITAL) & (behind == SMALL)))))
    solid = kind > 0
    at = np.cumsum(solid)[starts] - 1 if len(starts) else starts
    data = _LOWER[raw[solid]]
    edges = np.append(at, len(data)).astype(np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
    first = np.searchsorted(starts, bounds)  # token with which each text begins
    order = pc.sort_indices(tokens.dictionary).to_numpy()
    n = max(len(order), 1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs = np.sort(np.repeat(np.arange(len(texts)) * n, np.diff(first)) + rank[tokens.indices.to_numpy()])
    heads = np.flatnonzero(np.diff(pairs, prepend=-1))
    terms = tokens.dictionary.take(pa.array(order[pairs[heads] % n])).cast(pa.string())
    found = pa.StructArray.from_arrays([terms, pa.array(np.diff(np.append(heads, len(pairs))), pa.int64())], ["term", "tf"])
    offsets = np.searchsorted(pairs[heads], np.arange(len(texts) + 1) * n).astype(np.int32)
    return np.diff(first), pa.ListArray.from_arrays(pa.array(offsets), found, mask=pa.array(np.diff(offsets) == 0))


def counted_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, dl, counts.  A document is a row, so its terms are counted there, some texts of a batch at once: nothing is shuffled."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(sizes) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    dl, counts = token_counts(batch.column(1).slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(dl, pa.int32()), counts], ["doc_id", "dl", "counts"])

    return rows.mapInArrow(work, T.StructType([rows.schema["doc_id"], T.StructField("dl", T.IntegerType()), T.StructField("counts", COUNTS)]))


def term_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, tf, dl."""
    return counted_documents(docs, key, text).select("doc_id", "dl", F.inline("counts")).select("doc_id", "term", "tf", "dl")


def corpus_counts(documents: DataFrame) -> DataFrame:
    """term, df, total of counted documents: how many hold each term, and in the row without term all documents and their tokens; one pass."""
    every = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.col("counts.term"), F.array().cast("array<string>")))
    return documents.select("dl", F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total"))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Corpus counts of several parts of a corpus as those of the whole; what `negated` took out goes."""
    every = counts[0].select("term", "df", "total")
    for more in counts[1:]:
        every = every.unionByName(more.select("term", "df", "total"))
    return every.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).filter("df > 0 OR term IS NULL")


def negated(counts: DataFrame) -> DataFrame:
    """Corpus counts of documents that leave."""
    return counts.select("term", (-F.col("df")).alias("df"), (-F.col("total")).alias("total"))


def document_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """n_docs, avg_len over all documents, empty ones too."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokenize(F.col(text)))).alias("avg_len"))


def weighted(df: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """term, df, idf of the document frequencies."""
    one = stats.select("n_docs")  # one row
    raw = df.join(F.broadcast(one)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def from_counts(documents: DataFrame, counts: DataFrame) -> SparseIndex:
    """The index of counted documents and their corpus counts (see `corpus_counts`)."""
    stats = counts.filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_docs"), (F.sum("total") / F.sum("df")).alias("avg_len"))
    return SparseIndex(documents, weighted(counts.filter("term IS NOT NULL").select("term", "df"), stats), stats)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> SparseIndex:
    """The index of texts.  The corpus counts, a row for each term, are stored: terms and statistics come from them without another pass."""
    documents = counted_documents(docs, key, text)
    return from_counts(documents, stored(corpus_counts(documents)))


def question_terms(queries: DataFrame, key: str = "query_id", text: str = "question") -> DataFrame:
    """query_id, term, qtf of the questions that aren't blank."""
    asked = queries.filter(F.trim(text_or_empty(F.col(text))) != "")
    return asked.select(F.col(key).alias("query_id"), F.explode(query_tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def contribution(idf: Column, tf: Column, dl: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    """What a term adds to a document's score."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_len))


def bm25_scores(index: SparseIndex, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score of every document with an asked term, by a join on the term: for any number of asked terms."""
    hits = index.postings.join(terms.join(index.terms.select("term", "idf"), "term"), "term").join(F.broadcast(index.stats))  # stats: one row
    part = F.col("qtf") * contribution(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avg_len"), k1, b)
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def best_of_block(best: tuple[np.ndarray, np.ndarray], asked: list[tuple[int, float]], postings: dict[int, tuple[np.ndarray, np.ndarray, float]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (scores, ids) of a query after a block of documents, and how many of the block were scored.

    postings: for each term of the block the documents (places in `ids`, ascending), what the term adds to each, and the
    most it adds to any.  Terms are ordered by that bound.  The longest run of weak terms whose bounds together
    stay below the k-th score so far can't bring in a document by themselves, so only documents with one
    of the other terms are scored; if no other term is left, none is.
    """
    here = sorted(((max(0.0, q * postings[t][2]), q, t) for t, q in asked if t in postings), key=lambda x: x[:2])
    if not here:
        return *best, 0
    scores, names = best
    least = scores[-1] - SLACK if len(scores) >= k else 0.0
    bounds = np.cumsum([x[0] for x in here])
    weak = int(np.searchsorted(bounds, least)) if least > 0 else 0
    if weak == len(here):
        return *best, 0
    strong = [postings[t][0] for _, _, t in here[weak:]]
    found = strong[0] if len(strong) == 1 else np.unique(np.concatenate(strong))
    sums = np.zeros(len(found))
    for _, q, t in here:
        docs, adds, _ = postings[t]
        at = np.searchsorted(found, docs)
        held = found[np.minimum(at, len(found) - 1)] == docs
        sums[at[held]] += q * adds[held]
    good = sums > max(least, 0.0)
    scores, names = np.concatenate([scores, sums[good]]), np.concatenate([names, ids[found[good]]])
    order = np.lexsort((names, -np.round(scores, 9)))[:k]
    return scores[order], names[order], len(found)


def pruned_topk(index: SparseIndex, asked: list, k: int, out: T.StructType, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score: each task's k best documents of every query, scored where their rows lie.

    `asked`: rows of query_id, term, qtf, idf.  Documents' asked terms are looked up as they are read; a task works on
    blocks of documents and leaves out what can't be among its k best (`best_of_block`).
    """
    spark = index.documents.sparkSession
    codes = {t: i for i, t in enumerate(sorted({r.term for r in asked}))}
    idf = np.zeros(len(codes))
    terms: dict = {}
    for r in asked:
        idf[codes[r.term]] = r.idf
        terms.setdefault(r.query_id, []).append((codes[r.term], float(r.qtf)))
    shared = spark.sparkContext.broadcast((list(terms), list(terms.values()), idf))  # at most ASKED_TERMS entries
    coded = spark.createDataFrame(list(codes.items()), "term string, code int")
    rows = index.documents.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "dl", F.inline("counts"))
    hits = rows.join(F.broadcast(coded), "term").join(F.broadcast(index.stats.select("avg_len")))  # a document's terms stay together
    hits = hits.select("row", "doc_id", "code", contribution(F.lit(1.0), F.col("tf"), F.col("dl"), F.col("avg_len"), k1, b).alias("part"))
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, questions, idf = shared.value
        best = [(np.zeros(0), np.zeros(0, dtype=object))] * len(names)

        def scored(table: pa.Table) -> None:
            row, code = table["row"].to_numpy(), table["code"].to_numpy()
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            ids = np.array(table["doc_id"].take(pa.array(heads)).to_pylist(), dtype=object)
            doc = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(row))))
            adds = table["part"].to_numpy() * idf[code]
            order = np.argsort(code, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(order))
            postings = {}
            for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                own = adds[order[x:y]]
                postings[int(code[order[x]])] = (doc[order[x:y]], own, float(own.max()))
            for i, question in enumerate(questions):
                best[i] = best_of_block(best[i], question, postings, ids, k)[:2]

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= BLOCK_HITS:
                table = pa.Table.from_batches(held)
                row = table["row"].to_numpy()
                cut = int(np.searchsorted(row, row[-1]))  # the last document may go on
                scored(table.slice(0, cut)) if cut else None
                held = table.slice(cut).to_batches()
        if held:
            scored(pa.Table.from_batches(held))
        n = [len(s) for s, _ in best]
        columns = [[name for name, m in zip(names, n, strict=True) for _ in range(m)], [x for _, ids in best for x in ids], [x for s, _ in best for x in s.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], out.fieldNames())

    return hits.mapInArrow(work, out)


def bm25_topk(index: SparseIndex, queries: DataFrame, k: int = 10, query_key: str = "query_id", question: str = "question", most: int = ASKED_TERMS) -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents with a positive score; ties go to the smaller id.

    Up to `most` asked terms go to every task, and of each task at most k rows for each query are shuffled; beyond
    that, terms and postings are joined and summed up.
    """
    known = question_terms(queries, query_key, question).join(index.terms.select("term", "idf"), "term").select("query_id", "term", "qtf", "idf")
    asked = known.limit(most + 1).collect() if k > 0 else []
    out = T.StructType([T.StructField("query_id", known.schema["query_id"].dataType), T.StructField("doc_id", index.documents.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    if not asked:
        return index.documents.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(1))
    if len(asked) > most:
        scores = bm25_scores(index, known.drop("idf")).filter("score > 0")
    else:
        scores = pruned_topk(index, asked, k, out)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
