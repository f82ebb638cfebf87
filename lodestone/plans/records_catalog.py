"""More queries over the driver's tables, with their SQL: files and chunks, records of other tools, answers, reports, tables on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answering, chunking, dense, evaluation, ordering, records, sparse
from ..session import checkpoint_folder, stored
from ..sources.repository import read_eval_set, read_repository
from ..streaming import refresh
from . import store
from .catalog import _PAIRS, _samples, lines_sql, query, table, tok


def _folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all machines share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/lodestone-{what}-{uuid.uuid4().hex}"


# files and chunks ----------------------------------------------------------------

_PY = '''"""Module {i}."""
import os
LIMIT = {i}

@wraps
def top_{i}(x):
    """Doc {i}."""
    return x


class Box{i}:
    def get(self):
        return {i}
'''
_PARTS = [("__module__", 2, 3, "Module {i}."), ("top_{i}", 5, 8, "Doc {i}."), ("Box{i}", 11, 13, ""), ("Box{i}.get", 12, 13, "")]


def _spelled(text: str) -> str:
    """SQL of a text in which {i} stands for a document's id."""
    return " || ".join("'" + part.replace("'", "''") + "'" for part in text.split("{i}")).replace(" || ", " || CAST(doc_id AS VARCHAR) || ").replace("\n", "' || chr(10) || '")


_PY_PATH = "CASE WHEN doc_id % 7 = 0 THEN 'node_modules/' ELSE 'src/' END || 'm' || CAST(doc_id AS VARCHAR) || '.py'"
#: What breaks a file: a header at its top, or a function in its middle; and how many lines come before the first and the other symbols.
_MIDDLE = "def broken_{i}(x:\n    return [x, {\n\n\n"
_BROKEN = {0: ("def (\n" + _PY, 1, 1), 1: (_PY.replace("class", _MIDDLE + "class"), 0, 4)}


def _rows_sql(text: str, parts: list, where: str) -> str:
    lines = text.splitlines()
    return " UNION ALL ".join(
        f"SELECT {_PY_PATH} AS filepath, {_spelled(name)} AS function_name, {a} AS start_line, {b} AS end_line, {_spelled(doc)} AS docstring, {_spelled(chr(10).join(lines[a - 1 : b]))} AS source FROM labels WHERE {where} AND doc_id % 7 <> 0"
        for name, a, b, doc in parts
    )


_PY_ROWS = " UNION ALL ".join(
    [_rows_sql(_PY, _PARTS, "doc_id % 5 > 1")]
    + [_rows_sql(text, [(n, a + (up if n.startswith("top") else down), b + (up if n.startswith("top") else down), "") for n, a, b, _ in _PARTS[1:]], f"doc_id % 5 = {k}") for k, (text, up, down) in _BROKEN.items()]
)


@query(f"SELECT substr(sha1(concat_ws(':', filepath, function_name, CAST(start_line AS VARCHAR), CAST(end_line AS VARCHAR))), 1, 16) AS id, filepath, function_name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, docstring, source FROM ({_PY_ROWS})")
def python_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a generated file for each label; two in five don't parse, some lie in an ignored folder."""
    i = F.col("doc_id").cast("string")
    path = F.concat(F.when(F.col("doc_id") % 7 == 0, "node_modules/").otherwise("src/"), F.lit("m"), i, F.lit(".py"))
    text = F.lit(_PY)
    for k, (broken, *_) in _BROKEN.items():
        text = F.when(F.col("doc_id") % 5 == k, F.lit(broken)).otherwise(text)
    return chunking.chunk_files(table(spark, d, "labels").select(path.alias("filepath"), F.replace(text, F.lit("{i}"), i).alias("raw_content"))).drop("language")


_README = "CASE WHEN doc_id % 2 = 0 THEN '# C# ' || source || chr(10) || replace(text, '. ', '.' || chr(10) || '## ') ELSE text END"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT doc_id, {lines_sql("t")} AS x FROM (SELECT doc_id, {_README} AS t FROM documents))),
t AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l), h AS (SELECT *, regexp_matches(s, '^#{{1,6}}\\s+\\S') AS is_h FROM t),
g AS (SELECT *, sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hn,
  CASE WHEN s <> '' AND coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY pos), '') = '' THEN 1 ELSE 0 END AS opens FROM h),
w AS (SELECT *, CASE WHEN hn > 0 THEN 0 ELSE sum(opens) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS pn FROM g WHERE hn > 0 OR s <> ''),
c AS (SELECT doc_id, hn, pn, min(pos) AS a, max(pos) AS b, CASE WHEN hn > 0 THEN regexp_replace(arg_min(s, pos), '^#{{1,6}}\\s+', '') ELSE substr(arg_min(s, pos), 1, 80) END AS title FROM w GROUP BY doc_id, hn, pn),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS part, substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM c)
SELECT 'docs/' || CAST(doc_id AS VARCHAR) || '/README.md' AS filepath, 'README:' || CASE WHEN slug = '' THEN 'part-' || CAST(part AS VARCHAR) ELSE slug END AS function_name, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, title AS docstring FROM n"""
)
def readme_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the documents as readmes, half of them with headings."""
    headed = F.concat(F.lit("# C# "), "source", F.lit("\n"), F.replace("text", F.lit(". "), F.lit(".\n## ")))
    files = table(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit("/README.md")).alias("filepath"), F.when(F.col("doc_id") % 2 == 0, headed).otherwise(F.col("text")).alias("raw_content"))
    return chunking.chunk_files(files).select("filepath", "function_name", "start_line", "end_line", "docstring")


_NAMES = ["LICENSE.md", "b.js", "b.min.js", "README.rst", "x.html", "x.py", "y.py", "z.ts"]
_KIND = "page_id % 8"


@query(
    f"""WITH f AS (SELECT page_id, {_KIND} AS k, len({lines_sql("html")}) AS n FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'license' WHEN 2 THEN 'generated' WHEN 4 THEN 'unsupported_type' WHEN 5 THEN 'binary_or_non_utf8' WHEN 6 THEN 'generated'
  WHEN 7 THEN 'too_many_lines:' || CAST(n + 3 AS VARCHAR) ELSE CASE WHEN n > 3 THEN 'too_many_lines:' || CAST(n AS VARCHAR) END END AS skip_reason FROM f"""
)
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why each page, as one of eight kinds of file, is left out or not."""
    kind = F.col("page_id") % 8
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (kind + 1).cast("int"))
    text = F.when(kind == 6, F.concat(F.lit("# Code. DO NOT EDIT\n"), "html")).when(kind == 7, F.concat(F.lit("1\n2\n3\n"), "html")).otherwise(F.col("html"))
    content = F.when(kind == 5, F.concat(F.unhex(F.lit("00")), F.encode("html", "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    files = table(spark, d, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit("/"), name).alias("filepath"), content.alias("content"))
    found = chunking.ingest(files, 3).select(F.split("filepath", "/")[0].cast("long").alias("page_id"), "skip_reason")
    return found


@query("SELECT reason, count(*) AS files FROM (SELECT CASE page_id % 8 WHEN 0 THEN 'license' WHEN 2 THEN 'generated' WHEN 4 THEN 'unsupported_type' WHEN 5 THEN 'binary_or_non_utf8' WHEN 6 THEN 'generated' WHEN 7 THEN 'too_many_lines' ELSE CASE WHEN len(" + lines_sql("html") + ") > 3 THEN 'too_many_lines' END END AS reason FROM pages) WHERE reason IS NOT NULL GROUP BY reason")
def skip_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunking.skip_counts(skip_reasons(spark, d))


@query("SELECT doc_id, path FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/test/' WHEN 2 THEN 'src/' WHEN 3 THEN 'src/test_' ELSE 'testing/' END || CAST(doc_id AS VARCHAR) || '.py' AS path FROM documents) WHERE doc_id % 5 IN (2, 4)")
def paths_without_tests(spark: SparkSession, d: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ["tests/", "src/test/", "src/", "src/test_", "testing/"])), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(folder, F.col("doc_id").cast("string"), F.lit(".py")).alias("path"))
    return chunking.filter_paths(rows, exclude_tests=True, path="path")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The documents as chunks: their hosts are files, their languages functions."""
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("filepath"), F.col("lang").alias("function_name"), (F.col("doc_id") % 50).cast("int").alias("start_line"),
        (F.col("doc_id") % 50 + F.col("n_chars") % 9).cast("int").alias("end_line"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("about "), "lang")).otherwise("").alias("docstring"), F.col("text").alias("source"), F.col("lang").alias("language"),
    )


_CHUNKS = "c AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS filepath, lang AS function_name, doc_id % 50 AS start_line, doc_id % 50 + n_chars % 9 AS end_line, CASE WHEN doc_id % 3 = 0 THEN 'about ' || lang ELSE '' END AS docstring, text AS source, lang AS language FROM documents)"


@query(f"WITH {_CHUNKS} SELECT id, sha256('path: ' || filepath || chr(10) || 'symbol: ' || function_name || chr(10) || 'language: ' || language || chr(10) || CASE WHEN docstring <> '' THEN 'docstring: ' || docstring || chr(10) ELSE '' END || 'source:' || chr(10) || source) AS embedded, sha256(concat_ws(' ', function_name, nullif(docstring, ''), nullif(source, ''), filepath)) AS indexed FROM c")
def indexed_texts(spark: SparkSession, d: str) -> DataFrame:
    """What of each chunk is embedded, and what goes to the word index."""
    return _chunks(spark, d).select("id", X.text_hash(dense.embedding_text()).alias("embedded"), X.text_hash(sparse.chunk_document()).alias("indexed"))


@query(f"WITH {_CHUNKS} SELECT id, row_number() OVER (ORDER BY filepath, start_line, end_line, function_name, id) AS place FROM c")
def corpus_places(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).select("id", "filepath", "start_line", "end_line", "function_name")
    return ordering.positions(rows, *chunking.corpus_order(), F.asc("id"), name="place").select("id", "place")


_LANES = ", ".join(f"list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(ds, lambda d: CAST(CAST('0x' || substr(d, {15 * i + 1}, 15) AS BIGINT) AS HUGEINT))), lambda h, d: (h * {b} + d) % {ordering.PRIME}) AS h{i}" for i, b in enumerate(ordering.BASES))


@query(
    f"""WITH {_CHUNKS}, r AS (SELECT *, sha256(array_to_string(list_transform([id, filepath, function_name, CAST(start_line AS VARCHAR), CAST(end_line AS VARCHAR), docstring, source, language], lambda x: coalesce(x, '') || chr(0)), '')) AS d FROM c),
s AS (SELECT count(*) AS n, list(d ORDER BY filepath, start_line, end_line, function_name, id, d) AS ds FROM r), l AS (SELECT n, {_LANES} FROM s)
SELECT sha256(concat_ws(':', CAST(n AS VARCHAR), {", ".join(f"CAST(h{i} AS VARCHAR)" for i in range(len(ordering.BASES)))})) AS fingerprint FROM l"""
)
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A digest of all chunks in the corpus's order, put together from those of its parts."""
    return store.fingerprint_of(_chunks(spark, d))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE doc_id % 3 <> 0")
def embedding_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose vector is not in the cache: it knows a third of them, and a third with another text."""
    chunks = _chunks(spark, d)
    known = chunks.select(F.lit("hashing-64").alias("model_name"), F.col("id").alias("chunk_id"), F.when(F.col("id").cast("long") % 3 == 0, X.text_hash(dense.embedding_text())).otherwise("old").alias("text_sha256"), F.lit(None).cast("array<float>").alias("embedding"))
    _, fresh = dense.embed_missing(chunks, known.filter(F.col("chunk_id").cast("long") % 3 != 2), "hashing-64")
    return fresh.select("chunk_id")


@query("SELECT a.vec_id, round(CASE WHEN list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) IS NULL THEN 0 ELSE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) END, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM n) SELECT query_id, doc_id, rank, round(1 - s, 6) AS distance, round(s, 6) AS score FROM r WHERE rank <= 7")
def dense_distances(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rows with their distance, and the score that follows from it; the queries go in blocks."""
    rows = table(spark, d, "embeddings")
    near = dense.knn_topk(rows, rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 7, block=3).withColumn("distance", 1 - F.col("score"))
    return near.select("query_id", "doc_id", "rank", F.round("distance", 6).alias("distance"), F.round(dense.score_from_distance(F.col("distance")), 6).alias("score"))


@query("SELECT page_id, regexp_extract(u, '([^/:]+)$', 1) AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\.git)?/*$', '') AS u FROM pages)")
def repository_names(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), r"(\.git)?/*$", "")
    ending = F.element_at(F.array(*map(F.lit, ["", ".git", "/", ".git/"])), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", X.repo_name(F.concat(bare, ending)).alias("name"))


# tables on disk ------------------------------------------------------------------

@query(
    f"""WITH d AS (SELECT {tok("'benchmark item_' || CAST(item_id AS VARCHAR) || ' ' || text || ' benchmark.md'")} AS toks FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark),
t AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM d) GROUP BY term), r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM t, n)
SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM r) ELSE r END, 6) AS idf, (SELECT n FROM n) AS chunk_count FROM r"""
)
def index_tables(spark: SparkSession, d: str) -> DataFrame:
    """The terms of an index that was written, with its vectors and manifest, and opened again."""
    items = table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.lit("benchmark.md").alias("filepath"), F.concat(F.lit("benchmark item_"), F.col("item_id").cast("string")).alias("function_name"), F.lit(1).alias("start_line"),
        F.lit(2).alias("end_line"), F.lit("").alias("docstring"), F.col("text").alias("source"), F.lit("text").alias("language"),
    )
    path = _folder(spark, "index")
    store.write_index(items, path)
    manifest = store.read_json(spark, f"{path}/manifest.json")
    cached = spark.read.parquet(f"{path}/embedding_cache").count()
    if not store.exists(spark, f"{path}/vectors") or cached != manifest["chunk_count"] or manifest["fingerprint"] != store.fingerprint(spark.read.parquet(f"{path}/chunks")):
        raise AssertionError("the index isn't whole")
    return store.load_sparse(spark, path).terms.select("term", "df", F.round("idf", 6).alias("idf"), F.lit(manifest["chunk_count"]).cast("long").alias("chunk_count"))


def _merged_sql(corpus: str) -> str:
    """Terms with their weights of a corpus (text), as an index has them."""
    return f"""d AS (SELECT {tok("text")} AS toks FROM {corpus}), n AS (SELECT count(*) AS n FROM d),
t AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM d) GROUP BY term), r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM t, n)
SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM r) ELSE r END, 6) AS idf, (SELECT n FROM n) AS chunk_count FROM r"""


_ITEM = "'benchmark item_' || CAST(item_id AS VARCHAR) || ' ' || {} || ' benchmark.md'"


@query(
    f"""WITH now AS (SELECT {_ITEM.format("text")} AS text FROM benchmark WHERE item_id % 3 <> 0 AND item_id % 5 <> 1
UNION ALL SELECT {_ITEM.format("'changed ' || text")} FROM benchmark WHERE item_id % 3 = 0
UNION ALL SELECT 'benchmark new_' || CAST(item_id AS VARCHAR) || ' ' || text || ' benchmark.md' FROM benchmark WHERE item_id % 7 = 2), {_merged_sql("now")}"""
)
def updated_index_tables(spark: SparkSession, d: str) -> DataFrame:
    """The terms of an index after an update: a third of its chunks changed, some gone, some new, the others left alone."""
    items = table(spark, d, "benchmark")

    def chunks(rows: DataFrame, text: F.Column, prefix: str = "item_") -> DataFrame:
        name = F.concat(F.lit(prefix), F.col("item_id").cast("string"))
        return rows.select(
            name.alias("id"), F.lit("benchmark.md").alias("filepath"), F.concat(F.lit("benchmark "), name).alias("function_name"), F.lit(1).alias("start_line"),
            F.lit(2).alias("end_line"), F.lit("").alias("docstring"), text.alias("source"), F.lit("text").alias("language"),
        )

    path = _folder(spark, "index")
    store.write_index(chunks(items, F.col("text")), path)
    changed, left = items.filter("item_id % 3 = 0"), items.filter("item_id % 3 <> 0 AND item_id % 5 <> 1")
    now = chunks(changed, F.concat(F.lit("changed "), "text")).unionByName(chunks(left, F.col("text"))).unionByName(chunks(items.filter("item_id % 7 = 2"), F.col("text"), "new_"))
    manifest, added, gone = store.replace_chunks(spark, path, chunks(items, F.col("text")), now)
    index = store.load_sparse(spark, path)
    whole = [spark.read.parquet(f"{path}/{n}").count() for n in ("chunks", "vectors", "counted")]
    if {*whole} != {manifest["chunk_count"]} or manifest["fingerprint"] != store.fingerprint(now) or added - gone != manifest["chunk_count"] - items.count():
        raise AssertionError("the index isn't whole")
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"), F.lit(manifest["chunk_count"]).cast("long").alias("chunk_count"))


@query(f"WITH {_merged_sql('documents')}")
def refreshed_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of an index that grew by three batches, of which one came twice and one brought known documents again."""
    docs, path = table(spark, d, "documents"), _folder(spark, "refresh")
    deal = F.pmod(F.col("doc_id"), F.lit(3))
    for number, parts in ((0, [0]), (1, [1]), (1, [1]), (2, [1, 2])):
        refresh.add_batch(docs.filter(deal.isin(parts)), number, path)
    index = refresh.live_index(spark, path)
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf")).join(F.broadcast(index.stats.select(F.col("n_docs").cast("long").alias("chunk_count"))))


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) AS filepath, sha256(text) AS content FROM documents")
def raw_files(spark: SparkSession, d: str) -> DataFrame:
    """Raw files written as JSON lines and read again."""
    path = _folder(spark, "raw")
    store.write_raw_files(table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("filepath"), F.col("text").alias("raw_content")), path)
    back = spark.read.schema("filepath string, raw_content string").json(path)
    return back.select("filepath", X.text_hash(F.col("raw_content")).alias("content"))


@query("SELECT CAST(doc_id AS VARCHAR) AS condition_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, CASE WHEN toxic = 1 THEN '' ELSE printf('%.6f', doc_id / 7.0) END AS rate, '' AS note FROM labels")
def report_csv(spark: SparkSession, d: str) -> DataFrame:
    """A report written as CSV and read again; nulls are empty."""
    path = _folder(spark, "report")
    rate = F.when(F.col("toxic") != 1, F.col("doc_id") / F.lit(7.0))
    store.write_report(table(spark, d, "labels").select(F.col("doc_id").alias("condition_id"), "quality", rate.alias("rate"), F.lit(None).cast("string").alias("note")), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, turn, role FROM conversations WHERE turn = 0")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Records appended to a log twice, and its lines read again."""
    path = _folder(spark, "log")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    store.append_jsonl(store.log_records(rows), path)
    store.append_jsonl(rows.filter("turn = 0"), path)
    store.append_jsonl(rows, "none")
    return spark.read.schema("conv_id long, turn long, role string").json(path)


# records of other tools ------------------------------------------------------------


def _json(spark: SparkSession, d: str, *forms: str) -> DataFrame:
    """A JSON record for each turn, in one of several forms, in which @ stands for the conversation and # for the turn."""
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("turn") % len(forms) + 1).cast("int"))
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    return rows.withColumn("payload", F.replace(F.replace(form, F.lit("@"), F.col("conv_id").cast("string")), F.lit("#"), F.col("turn").cast("string")))


_C, _T = "CAST(conv_id AS VARCHAR)", "CAST(turn AS VARCHAR)"


@query(
    f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'c' || {_C} WHEN 1 THEN {_C} WHEN 2 THEN '' END AS id, CASE turn % 4 WHEN 3 THEN NULL WHEN 2 THEN 'f2' ELSE 'a/' || {_C} || '.py' END AS filepath,
CASE turn % 4 WHEN 0 THEN 'fn' WHEN 1 THEN 'sym' WHEN 2 THEN '' END AS function_name, CASE turn % 4 WHEN 0 THEN turn WHEN 1 THEN 0 WHEN 2 THEN 7 END AS start_line, CASE turn % 4 WHEN 0 THEN 's' || {_T} WHEN 1 THEN 'body' WHEN 2 THEN '' END AS source FROM conversations"""
)
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    """The fields of chunk records under their several names; one form is no record at all."""
    rows = _json(
        spark, d, '{"id": "c@", "filepath": "a/@.py", "function_name": "fn", "start_line": #, "source": "s#"}', '{"chunk": {"chunk_id": "@", "path": "a/@.py", "symbol_name": "sym", "start_line": "x", "text": "body"}}', '{"file": "f2", "start_line": "7", "name": null}', "plain text"
    )
    chunk = lambda n: F.col(f"chunk.{n}").alias(n)
    return records.normalise_chunks(rows).select("conv_id", "turn", chunk("id"), chunk("filepath"), chunk("function_name"), F.col("chunk.start_line").cast("long").alias("start_line"), chunk("source"))


@query(
    f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'r' || {_T} WHEN 2 THEN '' ELSE 'bare ' || {_C} END AS answer, CASE turn % 4 WHEN 0 THEN 'a/' || {_C} || '.py::f|b.py' WHEN 1 THEN 'p' || {_T} ELSE '' END AS contexts,
CASE turn % 4 WHEN 0 THEN 'code' ELSE '' END AS sources, CASE turn % 4 WHEN 0 THEN 'a/' || {_C} || '.py::f' || chr(10) || 'code|b.py' WHEN 1 THEN 'p' || {_T} ELSE '' END AS judged, CASE turn % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'p' || {_T} ELSE '' END AS scored FROM conversations"""
)
def output_records(spark: SparkSession, d: str) -> DataFrame:
    """Answers and contexts of pipelines' outputs, whatever they call them, and what judges and scorers are given of them."""
    rows = _json(
        spark, d, '{"answer": "yes", "retrieved_chunks": [{"filepath": "a/@.py", "function_name": "f", "source": "code"}, {"chunk": {"path": "b.py"}}, {"name": "nowhere"}]}', '{"response": "r#", "retrieved_chunks": [], "citations": [{"file": "p#", "symbol_name": ""}]}', '{"contexts": null}', "bare @"
    )
    out = records.normalise_outputs(rows)
    places = F.array_join(F.transform(out["contexts"], lambda c: records.place(c, "::")), "|")
    whole = F.transform(out["contexts"], lambda c, i: F.struct(c["filepath"].alias("filepath"), c["function_name"].alias("function_name"), F.get(out["sources"], i).alias("source")))
    return out.select("conv_id", "turn", "answer", places.alias("contexts"), F.array_join(out["sources"], "|").alias("sources"), F.array_join(records.judge_contexts(whole), "|").alias("judged"), F.array_join(records.scorer_contexts(out["sources"], out["contexts"]), "|").alias("scored"))


@query("SELECT conv_id, min(turn) AS turn, CASE WHEN turn % 3 = 0 THEN 'id:' || CAST(turn % 6 AS VARCHAR) ELSE 'loc:f' || CAST(turn % 4 AS VARCHAR) || ':fn:1:2' END AS place FROM conversations GROUP BY conv_id, place")
def first_chunks_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk of a conversation's turns once, by id or, where there is none, by place."""
    chunk = F.struct(
        F.when(F.col("turn") % 3 == 0, (F.col("turn") % 6).cast("string")).otherwise("").alias("id"), F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise(F.concat(F.lit("f"), (F.col("turn") % 4).cast("string"))).alias("filepath"),
        F.lit("fn").alias("function_name"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
    )
    once = records.first_chunks(table(spark, d, "conversations").withColumn("chunk", chunk), [F.asc("turn")], ("conv_id",))
    return once.select("conv_id", "turn", records.location_key(F.col("chunk")).alias("place"))


@query("SELECT text_hash, doc_id FROM (SELECT sha256(text) AS text_hash, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS p FROM documents) WHERE p = 1")
def first_seen_dedupe(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.fusion import first_seen

    docs = table(spark, d, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))
    return first_seen(docs, F.col("text_hash"), [F.asc("doc_id")]).select("text_hash", "doc_id")


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS s FROM conversations)
SELECT conv_id, string_agg(CAST(turn AS VARCHAR) || ':' || CASE WHEN length(s) <= 40 THEN s ELSE substr(s, 1, 37) || '...' END, '|' ORDER BY turn) FILTER (p <= 5) AS shown, greatest(count(*) - 5, 0) AS more FROM o GROUP BY conv_id"""
)
def shown_first(spark: SparkSession, d: str) -> DataFrame:
    """The first five turns of each conversation, shortened, and how many more there are."""
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", records.short_text(F.col("text"), 40).alias("s")))).alias("l"))
    first, more = records.heading(F.col("l"))
    return listed.select("conv_id", F.array_join(F.transform(first, lambda x: F.concat_ws(":", x["turn"].cast("string"), x["s"])), "|").alias("shown"), more.cast("long").alias("more"))


@query("SELECT conv_id, string_agg('c' || CAST(turn AS VARCHAR) || '/f.py:' || role || ':' || CAST(turn AS VARCHAR) || '-0', '|' ORDER BY turn) AS summary FROM conversations GROUP BY conv_id")
def chunk_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What a log holds of the chunks of each conversation."""
    chunk = F.struct("turn", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.lit("f.py").alias("filepath"), F.col("role").alias("function_name"), F.col("turn").cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.col("text").alias("source"))
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(records.chunk_summary(F.sort_array(F.collect_list(chunk))).alias("l"))
    each = lambda x: F.concat(x["id"], F.lit("/"), x["filepath"], F.lit(":"), x["function_name"], F.lit(":"), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"))
    return listed.select("conv_id", F.array_join(F.transform("l", each), "|").alias("summary"))


# answers ---------------------------------------------------------------------------


@query("""SELECT conv_id, turn, '[' || CAST(turn + 1 AS VARCHAR) || '] f' || CAST(conv_id AS VARCHAR) || '.py::' || role || ' lines ' || CAST(turn AS VARCHAR) || '-' || CAST(turn + 3 AS VARCHAR) || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Docstring: about ' || role || chr(10) ELSE '' END || 'Source:' || chr(10)
  || CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 105), '\\s+$', '') || chr(10) || '...[truncated]' END AS block FROM conversations""")  # fmt: skip
def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a numbered snippet of a prompt."""
    rows = table(spark, d, "conversations").withColumns({
        "filepath": F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.lit(".py")), "function_name": F.col("role"), "start_line": F.col("turn"), "end_line": F.col("turn") + 3,
        "docstring": F.when(F.col("turn") % 2 == 0, F.concat(F.lit("about "), "role")).otherwise(""), "source": F.col("text"),
    })
    return rows.select("conv_id", "turn", answering.render_chunk(F.col("turn") + 1, 120).alias("block"))


@query("SELECT a.conv_id, a.turn, a.text || chr(10) || chr(10) || 'Partial answer:' || chr(10) || b.text AS question FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def refined_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("partial"))
    return rows.join(following, ["conv_id", "turn"]).select("conv_id", "turn", answering.refined_question(F.col("text"), F.col("partial")).alias("question"))


_SAID = "CASE turn % 5 WHEN 0 THEN '  ' WHEN 1 THEN '- it is ' || role || ' [1] ' WHEN 2 THEN 'no citation' WHEN 3 THEN 'far off [9]' ELSE 'uses parseFile_now [1][2]' END"


@query(
    f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 OR turn % 5 IN (0, 2, 3) OR (turn % 5 = 4 AND turn % 4 < 2) OR (turn % 3 = 1 AND turn % 5 <> 4) THEN 'I cannot find this in the codebase.' ELSE trim({_SAID}, ' ') END AS answer FROM conversations"""
)
def guarded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that stand or are refused: no snippets, blank, no or wrong citation, or an identifier of the question missing."""
    forms = [F.lit("  "), F.concat(F.lit("- it is "), "role", F.lit(" [1] ")), F.lit("no citation"), F.lit("far off [9]"), F.lit("uses parseFile_now [1][2]")]
    said = F.element_at(F.array(*forms), (F.col("turn") % 5 + 1).cast("int"))
    question = F.when(F.col("turn") % 3 == 1, "what does ParseFile_now do?").otherwise("what is it?")
    return table(spark, d, "conversations").select("conv_id", "turn", answering.guarded(said, question, F.col("turn") % 4).alias("answer"))


_REFUSAL = X.REFUSAL_ANSWER


@query(
    f"""WITH {_PAIRS}, c AS (SELECT conv_id, round(avg(round(x, 6)), 6) AS confidence FROM p GROUP BY conv_id), f AS (SELECT conv_id, arg_min(text, turn) AS first FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
j AS (SELECT f.conv_id, first, coalesce(confidence, 0) AS confidence FROM f LEFT JOIN c ON c.conv_id = f.conv_id)
SELECT conv_id AS query_id, CASE WHEN confidence < 0.72 THEN '{_REFUSAL}' ELSE first END AS answer, CASE WHEN confidence < 0.72 THEN first END AS candidate_answer,
CASE WHEN confidence < 0.72 THEN 'The sampled answers agree by ' || printf('%.2f', confidence) || ' only; 0.72 is asked for.' END AS warning FROM j"""
)
def confident_answers(spark: SparkSession, d: str) -> DataFrame:
    """First answers, or the refusal where the samples agree too little."""
    samples = _samples(spark, d)
    judged = answering.confidence(samples, answering.agreement_pairs(samples))
    first = samples.groupBy("query_id").agg(F.min_by("answer", "sample").alias("answer"))
    return answering.apply_confidence(first, judged).select("query_id", "answer", "candidate_answer", "warning")


def _generator(messages: list[str], questions: list[str], temperature: float = 0.0, system: str = "") -> list[str]:
    """A model that follows from the question's last character."""
    if "snippets" not in system:
        raise ValueError("the system prompt is missing")
    return [{"0": "no citation", "1": "  ", "2": "see other_name() [1]"}.get(q.split("\n")[0][-1:], "- as shown [1]") for q in questions]


_ANSWERED = f"""a AS (SELECT item_id, 'question ' || CAST(item_id AS VARCHAR) AS question, item_id % 10 AS k, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id IN (b.item_id, b.item_id + 1)) AS found FROM benchmark b),
r AS (SELECT *, CASE WHEN NOT found OR k IN (0, 1) THEN '{_REFUSAL}' WHEN k = 2 THEN 'see other_name() [1]' ELSE '- as shown [1]' END AS answer FROM a)"""


@query(f"WITH {_ANSWERED} SELECT CAST(item_id AS VARCHAR) AS query_id, answer, 'iterative' AS mode, CAST(CASE WHEN answer = '{_REFUSAL}' THEN 1 ELSE 2 END AS BIGINT) AS passes, answer AS partial_answer, CASE WHEN answer LIKE 'see%' THEN 'other_name' ELSE '' END AS ungrounded, answer NOT LIKE 'see%' AS grounded FROM r")
def answered_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions through both passes of answering, with a model that follows a rule."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit("question "), F.col("item_id").cast("string")).alias("question"))

    def retrieve(queries: DataFrame) -> DataFrame:
        near = F.array(F.col("query_id"), (F.col("query_id").cast("long") + 1).cast("string"))
        return queries.select("query_id", F.posexplode(near).alias("at", "doc_id")).select("query_id", (F.col("at") + 1).alias("position"), "doc_id")

    chunks = _chunks(spark, d).withColumn("source", F.lit("as it stands")).withColumn("docstring", F.lit(""))
    out = answering.answer_questions(asked, retrieve, chunks, _generator)
    return out.select("query_id", "answer", "mode", "passes", "partial_answer", F.array_join("ungrounded_claims", "|").alias("ungrounded"), "grounded")


# evaluation ------------------------------------------------------------------------

_TRIES = ", ".join("'" + q.replace("'", "''") + "'" for q in evaluation.ADVERSARIAL_QUERIES)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as test items: the toxic ones are to be refused."""
    ref = F.struct(F.concat(F.lit("f"), (F.col("doc_id") % 10).cast("string")).alias("filepath"), F.lit(None).cast("string").alias("function_name"))
    return table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("q"), (F.col("doc_id") % 25).cast("string")).alias("question"), F.concat(F.lit("truth "), F.col("quality").cast("string")).alias("ground_truth_answer"),
        F.array(ref).alias("ground_truth_context"), (F.coalesce("toxic", F.lit(0)) == 1).alias("expected_refusal"),
    )


@query(f"SELECT DISTINCT 'q' || CAST(doc_id % 25 AS VARCHAR) AS question FROM labels WHERE toxic = 1 UNION SELECT unnest([{_TRIES}]) AS question")
def adversarial_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions to be refused and the standing ones, each once."""
    return evaluation.adversarial_queries(_items(spark, d)).select("question")


_ITEM_SQL = "i AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, coalesce(toxic, 0) = 1 AS refuse, quality FROM labels)"


@query(f"WITH {_ITEM_SQL} SELECT count(*) AS total_questions, avg(CASE WHEN NOT refuse THEN 1.0 END) AS context_hit_rate, avg(CASE WHEN NOT refuse THEN 1.0 END) AS context_recall, avg(CASE WHEN NOT refuse THEN 1.0 END) AS context_precision, avg(CASE WHEN NOT refuse THEN 1.0 END) AS answer_relevance_proxy, avg(CASE WHEN refuse THEN 1.0 END) AS refusal_accuracy FROM i")
def oracle_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the truth itself: all perfect."""
    items = _items(spark, d)
    out = evaluation.summary(evaluation.score_items(items, evaluation.oracle_answers(items)))
    return out.select("total_questions", "context_hit_rate", "context_recall", "context_precision", "answer_relevance_proxy", "refusal_accuracy")


#: By which rule each condition answers.
RULES = {"A": 3, "B": 4, "C": 5, "D": 6}


def _answers_by_rule(asked: DataFrame) -> DataFrame:
    """The outputs of all conditions: by the condition's rule a question is refused, or answered with its truth's first word."""
    n = F.element_at(F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair]), F.col("condition_id"))
    number = F.coalesce(F.substring_index("query_id", ":", -1).try_cast("long"), F.lit(0))
    at = (3 * F.length("question") + number) % n
    ref = F.struct(F.concat(F.lit("f"), (number % 7).cast("string")).alias("filepath"), F.lit("g").alias("function_name"))
    rows = asked.crossJoin(F.broadcast(evaluation.conditions(asked.sparkSession).select("condition_id")))  # four rows
    return rows.select(
        "condition_id", "query_id", F.when(at == 0, _REFUSAL).otherwise("truth [1]").alias("answer"), F.array(ref).alias("contexts"), (at != 1).alias("grounded"), (at / n).alias("confidence"), (at < 2).alias("should_refuse")
    )


_CONDITION_ROWS = ", ".join(f"('{c.id}', '{c.label}', '{c.retrieval}', '{c.retrieval_passes}', '{c.mode}', {RULES[c.id]})" for c in evaluation.CONDITIONS)


@query(
    f"""WITH {_ITEM_SQL}, c(condition_id, label, retrieval, retrieval_passes, mode, n) AS (VALUES {_CONDITION_ROWS}),
r AS (SELECT *, (3 * length('q' || CAST(doc_id % 25 AS VARCHAR)) + doc_id) % n AS v, CASE WHEN doc_id % 10 = doc_id % 7 THEN 1.0 ELSE 0.0 END AS hit FROM i, c),
q AS (SELECT 'q' || CAST(doc_id % 25 AS VARCHAR) AS question FROM i WHERE refuse UNION SELECT unnest([{_TRIES}])),
a AS (SELECT condition_id, count(*) AS adversarial_queries, round(avg(CASE WHEN v < 2 THEN 1.0 ELSE 0.0 END), 6) AS adversarial_refusal_rate FROM (SELECT condition_id, 3 * length(question) % n AS v FROM q, c) GROUP BY condition_id)
SELECT condition_id, first(label) AS label, first(retrieval) AS retrieval, first(retrieval_passes) AS retrieval_passes, first(mode) AS mode, count(*) AS total_questions,
  count(*) FILTER (NOT refuse) AS answerable_questions, count(*) FILTER (refuse) AS refusal_questions, round(avg(hit) FILTER (NOT refuse), 6) AS context_hit_rate,
  round(avg(hit) FILTER (NOT refuse), 6) AS context_recall, round(avg(hit) FILTER (NOT refuse), 6) AS context_precision,
  round(avg(CASE WHEN v = 0 THEN 0.0 ELSE 1.0 END) FILTER (NOT refuse), 6) AS answer_relevance_proxy, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) FILTER (refuse), 6) AS refusal_accuracy,
  first(adversarial_queries) AS adversarial_queries, first(adversarial_refusal_rate) AS adversarial_refusal_rate, round(avg(v / CAST(n AS DOUBLE)), 6) AS avg_confidence,
  round(avg(CASE WHEN v < 2 THEN 1.0 ELSE 0.0 END), 6) AS low_confidence_rate, round(avg(CASE WHEN v = 0 THEN {len(_REFUSAL)}.0 ELSE 9.0 END), 6) AS external_length
FROM r JOIN a USING (condition_id) GROUP BY condition_id"""
)
def ablation_report(spark: SparkSession, d: str) -> DataFrame:
    """The report over the four conditions, answered in one plan by rules."""
    scorer = lambda rows: rows.select("condition_id", F.length("answer").alias("length"))
    _, report = evaluation.run_conditions(_items(spark, d), _answers_by_rule, scorer)
    return report.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes])


@query(
    """SELECT c.id AS condition_id, count(*) AS items, count(DISTINCT mode) AS modes, round(avg(CASE WHEN l.doc_id % 4 = 0 OR l.doc_id % 3 = 0 OR l.doc_id % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS flagged
FROM (VALUES ('A', 'single'), ('B', 'single'), ('C', 'iterative'), ('D', 'iterative')) c(id, mode), labels l GROUP BY c.id"""
)
def flagged_by_condition(spark: SparkSession, d: str) -> DataFrame:
    """Each condition with each item, and how many answers are refused, of low confidence, or not grounded."""
    rows = evaluation.conditions(spark).crossJoin(table(spark, d, "labels"))  # four rows with each item
    answer = F.when(F.col("doc_id") % 4 == 0, _REFUSAL).otherwise("fine [1]")
    low, grounded = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0).otherwise(F.when(F.col("doc_id") % 3 == 0, True)), F.when(F.col("doc_id") % 5 == 0, False)
    flagged = evaluation.refused_or_flagged(answer, low, grounded)
    return rows.groupBy("condition_id").agg(F.count("*").alias("items"), F.count_distinct("mode").alias("modes"), F.round(evaluation.mean(flagged), 6).alias("flagged"))


@query(
    f"""WITH {_ITEM_SQL} SELECT 'AB'[1 + CAST(doc_id % 2 AS INT)] AS condition_id, round(avg(CASE WHEN doc_id % 6 <> 5 THEN coalesce(quality, 0) / 2.0 END), 6) AS answer_correctness, round(avg(CASE WHEN doc_id % 6 <> 5 THEN 1.0 END), 6) AS faithfulness, count(*) FILTER (doc_id % 6 = 5) AS errors,
round(avg(CASE WHEN NOT refuse THEN 1.0 END), 6) AS rouge1_f1 FROM i GROUP BY 1"""
)
def judged_ablation(spark: SparkSession, d: str) -> DataFrame:
    """A stored ablation read back, judged by a rule and summed up; some records fail."""
    items = _items(spark, d)
    path, out = _folder(spark, "ablation"), _folder(spark, "judged")
    rows = items.select(F.when(F.col("id").cast("long") % 2 == 0, "A").otherwise("B").alias("condition_id"), "id", "question", F.col("ground_truth_answer").alias("answer"), "expected_refusal")
    store.write_ablation(rows, rows.groupBy("condition_id").count(), path)

    def judge(row: dict) -> dict:
        if int(row["id"]) % 6 == 5:
            raise ValueError("no verdict")
        truth = row["ground_truth_answer"] or "0"
        return {"answer_correctness": int(truth.split()[-1]) / 2, "faithfulness": 7.0, "refusal_quality": float("nan")}

    summary = store.judge_ablation(spark, path, items, judge, out)
    return summary.select("condition_id", F.round("answer_correctness", 6).alias("answer_correctness"), F.round("faithfulness", 6).alias("faithfulness"), "errors", F.round("rouge1_f1", 6).alias("rouge1_f1"))


@query("SELECT lang, round(avg(n_chars), 4) AS external_n_chars, round(avg(length(text)), 4) AS external_size FROM documents GROUP BY lang")
def external_score_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", "n_chars", F.length("text").cast("double").alias("size"), "text")
    out = evaluation.external_means(rows, "lang")
    return out.select("lang", *[F.round(c, 4).alias(c) for c in out.columns if c != "lang"])


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'n/a' ELSE printf('%.3f', value) END AS value FROM events")
def metric_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", records.metric_text(F.col("value")).alias("value"))


# what needs files or vectors -------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(text: F.Column) -> F.Column:
    """How often a text has each letter."""
    each = lambda low: F.transform(F.array(*map(F.lit, _LETTERS)), lambda x: (F.length(low) - F.length(F.replace(low, x))).cast("double"))
    return X.let(F.lower(text), each)


_LETTERS_SQL = "list_transform([" + ", ".join(f"'{x}'" for x in _LETTERS) + "], lambda x: CAST(length(lower({t})) - length(replace(lower({t}), x, '')) AS DOUBLE))"
_MEANT = f"""{_PAIRS}, t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, {_LETTERS_SQL.format(t="text")} AS v FROM conversations WHERE role = 'assistant'),
m AS (SELECT p.*, least(1, greatest(0, coalesce(CASE WHEN list_sum(a.v) = 0 OR list_sum(b.v) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END, 0))) AS y FROM p JOIN t a ON a.conv_id = p.conv_id AND a.i = "left" JOIN t b ON b.conv_id = p.conv_id AND b.i = "right")"""


@query(f'WITH {_MEANT} SELECT conv_id AS query_id, "left", "right", round(x, 6) AS lexical, round(y, 6) AS semantic, round(0.4 * x + 0.6 * y, 6) AS combined FROM m')
def semantic_agreement_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of answers by their words and by the cosine of vectors, here of their letters."""
    pairs = answering.agreement_pairs(_samples(spark, d), semantic=X.cosine, features=_letters)
    return pairs.select("query_id", *[F.col(c).cast("long").alias(c) for c in ("left", "right")], "lexical", "semantic", "combined")


@query(
    f"""WITH {_MEANT}, c AS (SELECT conv_id, count(*) AS pairs, max(round(0.4 * x + 0.6 * y, 6)) AS best, round(avg(round(0.4 * x + 0.6 * y, 6)), 6) AS confidence FROM m GROUP BY conv_id), g AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) AS final FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT g.conv_id AS query_id, CAST(0.72 AS DOUBLE) AS threshold, n AS n_answers, final AS last_answer, coalesce(pairs, 0) AS n_pairs, coalesce(best, -1.0) AS best, coalesce(confidence, 0) AS confidence FROM g LEFT JOIN c ON c.conv_id = g.conv_id"""
)
def confidence_log(spark: SparkSession, d: str) -> DataFrame:
    """The confidence log's records, appended to a file and read again."""
    path, samples = _folder(spark, "confidence"), _samples(spark, d)
    pairs = stored(answering.agreement_pairs(samples, semantic=X.cosine, features=_letters))  # read twice, measured once
    store.append_jsonl(store.confidence_records(answering.confidence(samples, pairs), samples, pairs, answering.THRESHOLD, answering.TEMPERATURES), path)
    kind = "array<struct<left:int,right:int,lexical:double,semantic:double,combined:double>>"
    back = spark.read.schema(f"query_id long, threshold double, raw_answers array<string>, pair_scores {kind}, confidence double").json(path)
    scores = F.coalesce("pair_scores", F.array().cast(kind))
    return back.select(
        "query_id", "threshold", F.size("raw_answers").alias("n_answers"), F.element_at("raw_answers", -1).alias("last_answer"), F.size(scores).alias("n_pairs"),
        F.coalesce(F.array_max(F.transform(scores, lambda x: x["combined"])), F.lit(-1.0)).alias("best"), "confidence",
    )


@query(f"WITH {_ITEM_SQL} SELECT id, 'q' || CAST(doc_id % 25 AS VARCHAR) AS question, 'truth ' || CAST(quality AS VARCHAR) AS ground_truth_answer, 'f' || CAST(doc_id % 10 AS VARCHAR) AS place, refuse AS expected_refusal FROM i WHERE quality IS NOT NULL")
def evaluation_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items written as JSON lists and read with their checks."""
    path, items = _folder(spark, "items"), _items(spark, d).filter("ground_truth_answer IS NOT NULL")
    lists = items.groupBy(F.pmod(F.xxhash64("id"), F.lit(16)).alias("part")).agg(F.to_json(F.collect_list(F.struct(*items.columns))).alias("value"))
    lists.write.partitionBy("part").text(path)
    back = read_eval_set(spark, path)
    return back.select("id", "question", "ground_truth_answer", F.col("ground_truth_context")[0]["filepath"].alias("place"), "expected_refusal")


@query("SELECT CAST(doc_id AS VARCHAR) AS condition_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, printf('%.6f', doc_id / 7.0) AS rate FROM labels")
def report_read_back(spark: SparkSession, d: str) -> DataFrame:
    """A report written as CSV, read as the tools that compare reports read it."""
    path = _folder(spark, "summary")
    store.write_report(table(spark, d, "labels").select(F.col("doc_id").alias("condition_id"), "quality", (F.col("doc_id") / F.lit(7.0)).alias("rate")), path)
    return store.report_table(spark, path)


@query(
    """SELECT 'i' || CAST(item_id AS VARCHAR) || '/README.md' AS filepath, 'README:item-' || CAST(item_id AS VARCHAR) AS function_name, CAST(1 AS BIGINT) AS start_line, CAST(2 AS BIGINT) AS end_line FROM benchmark
UNION ALL SELECT 'i' || CAST(item_id AS VARCHAR) || '/src/code.py', 'f_' || CAST(item_id AS VARCHAR), 1, 2 FROM benchmark"""
)
def repository_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a tree of files that tasks wrote: a readme, a source file and one in an ignored folder for each item."""
    from collections.abc import Iterator

    import pyarrow as pa

    root = _folder(spark, "tree")
    i = F.col("item_id").cast("string")
    readme = F.concat(F.lit("# Item "), i, F.lit("\n"), F.regexp_replace("text", "[\\s#]+", " "))
    code = F.concat(F.lit("def f_"), i, F.lit("(x):\n    return x\n"))
    files = F.inline(F.array(*[F.struct(F.concat(F.lit("i"), i, F.lit(p)).alias("filepath"), t.alias("text")) for p, t in (("/README.md", readme), ("/src/code.py", code), ("/build/code.py", code))]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.sources.repository import opened

        system, top = opened(root)
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system.create_dir(f"{top}/{path.rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(text.encode())
            yield batch.select(["filepath"])

    written = table(spark, d, "benchmark").select(files).mapInArrow(write, "filepath string").count()
    found = read_repository(spark, root, all_folders=True)
    if found.count() != written:
        raise AssertionError("not all files are listed")
    text = found.select("filepath", F.decode("content", "UTF-8").alias("raw_content"))
    return chunking.chunk_files(text, 200).select("filepath", "function_name", "start_line", "end_line")
