"""Index tables and logs on disk: layout, manifest, fingerprint, sinks."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..operators import chunking, dense, evaluation, graph, sparse
from ..operators.ordering import ordered_digest
from ..operators.records import chunk_summary
from ..session import stored
from ..sources.repository import read_repository

VERSION = 3
CHUNK_COLUMNS = ["id", "filepath", "function_name", "start_line", "end_line", "docstring", "source", "language"]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"{old} could not be moved to {new}")


def row_digest(*columns: Column) -> Column:
    parts = [x for c in columns for x in (F.coalesce(c.cast("string"), F.lit("")), F.char(F.lit(0)))]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fingerprint_of(chunks: DataFrame) -> DataFrame:
    """One row, `fingerprint`: a digest of all chunks in the corpus's order."""
    rows = chunks.select("id", "filepath", "start_line", "end_line", "function_name", row_digest(*map(F.col, CHUNK_COLUMNS)).alias("digest"))
    return ordered_digest(rows, "digest", *chunking.corpus_order(), F.asc("id"), F.asc("digest"))


def fingerprint(chunks: DataFrame) -> str:
    return fingerprint_of(chunks).first().fingerprint


def build_index(
    spark: SparkSession, repository: str, path: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), exclude_tests: bool = False,
    max_chunk_lines: int | None = 220, overlap: int = 20, embedder: dense.Embedder | None = None, model: str = "hashing-64",
) -> dict:
    """Chunks, vectors and postings of a repository as tables below `path`, and a manifest, which is returned.
    Vectors of unchanged chunks come from the cache of earlier builds."""
    options = {"repository": repository, "include": list(include), "exclude": list(exclude), "exclude_tests": exclude_tests, "max_chunk_lines": max_chunk_lines, "chunk_overlap_lines": overlap}
    files = read_repository(spark, repository, all_folders=True)
    manifest = write_index(chunks_of(files, options), path, embedder, model, options)
    file_digests(files).write.mode("overwrite").parquet(f"{path}/files")
    return manifest


def chunks_of(files: DataFrame, options: dict) -> DataFrame:
    """The chunks of repository files (filepath, content) under an index's options."""
    text = files.select("filepath", F.when(chunking.is_text(F.col("content")), F.decode("content", "UTF-8")).alias("raw_content"))
    found = chunking.chunk_files(text, options["max_chunk_lines"], options["chunk_overlap_lines"])
    return chunking.filter_paths(found, tuple(options["include"]), tuple(options["exclude"]), options["exclude_tests"])


def file_digests(files: DataFrame) -> DataFrame:
    return files.select("filepath", F.sha2("content", 256).alias("sha256"))


def write_index(found: DataFrame, path: str, embedder: dense.Embedder | None = None, model: str = "hashing-64", options: dict | None = None) -> dict:
    """The tables of an index of chunks, and its manifest."""
    spark = found.sparkSession
    remove_path(spark, f"{path}/graph")
    found.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    count = chunks.count()
    if not count:
        raise ValueError("no chunks to index")
    write_vectors(chunks, path, embedder, model)
    write_counted(chunks, path)
    manifest = {"version": VERSION, "built_at": datetime.now(UTC).isoformat(), "model_name": model, "chunk_count": count, "fingerprint": fingerprint(chunks), **(options or {})}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
    return manifest


def write_vectors(chunks: DataFrame, path: str, embedder: dense.Embedder | None = None, model: str = "hashing-64", anew: bool = False) -> None:
    """The chunks' vectors: those that the cache below `path` knows come from there (not if `anew`), the others join it."""
    spark = chunks.sparkSession
    cache = spark.read.parquet(f"{path}/embedding_cache") if not anew and exists(spark, f"{path}/embedding_cache") else None
    vectors, fresh = dense.embed_missing(chunks, cache, model, embedder)
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    made = spark.read.parquet(f"{path}/vectors")
    new = made.join(fresh.select("chunk_id").distinct(), "chunk_id", "left_semi") if cache is not None else made
    new.select("model_name", "chunk_id", "text_sha256", "embedding").write.mode("overwrite" if anew else "append").parquet(f"{path}/embedding_cache")


def write_counted(chunks: DataFrame, path: str) -> None:
    """The chunks' counted terms, and the terms and statistics of them all."""
    docs = chunks.select(F.col("id").alias("doc_id"), sparse.chunk_document().alias("text"))
    sparse.counted_documents(docs).write.mode("overwrite").parquet(f"{path}/counted")
    write_terms(chunks.sparkSession, sparse.corpus_counts(chunks.sparkSession.read.parquet(f"{path}/counted")), path)


def write_terms(spark: SparkSession, counts: DataFrame, path: str) -> None:
    """Corpus counts, and the terms and statistics that follow from them."""
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    index = sparse.from_counts(spark.read.parquet(f"{path}/counted"), spark.read.parquet(f"{path}/counts"))
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")


def load_sparse(spark: SparkSession, path: str) -> sparse.SparseIndex:
    if not exists(spark, f"{path}/manifest.json"):
        raise FileNotFoundError(f"{path} holds no index; build one first")
    if read_json(spark, f"{path}/manifest.json")["version"] != VERSION:
        raise ValueError("the index was written by another version")
    return sparse.SparseIndex(*(spark.read.parquet(f"{path}/{n}") for n in ("counted", "terms", "stats")))


def write_graph(spark: SparkSession, path: str) -> None:
    """The proximity graph of an index's vectors, for approximate search."""
    graph.build_graph(spark.read.parquet(f"{path}/vectors"), "chunk_id").write.mode("overwrite").parquet(f"{path}/graph")


@dataclass(frozen=True)
class Change:
    """What an update did."""

    files: int
    added: int
    gone: int


def update_index(spark: SparkSession, path: str, embedder: dense.Embedder | None = None) -> tuple[dict, Change]:
    """Bring an index up to its repository's present files; its manifest, and what changed.

    Files are compared by digest, and only those that differ are cut into chunks.
    """
    manifest = read_json(spark, f"{path}/manifest.json")
    files = read_repository(spark, manifest["repository"], all_folders=True)
    now = stored(file_digests(files))
    both = spark.read.parquet(f"{path}/files").withColumnRenamed("sha256", "old").join(now.withColumnRenamed("sha256", "new"), "filepath", "full")
    differ = stored(both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("filepath"))
    changed = differ.count()
    if not changed:
        return manifest, Change(0, 0, 0)
    stale = spark.read.parquet(f"{path}/chunks").join(differ, "filepath", "left_semi")
    fresh = chunks_of(files.join(differ, "filepath", "left_semi"), manifest)
    manifest, added, gone = replace_chunks(spark, path, stale, fresh, embedder, now)
    return manifest, Change(changed, added, gone)


def replace_chunks(spark: SparkSession, path: str, stale: DataFrame, fresh: DataFrame, embedder: dense.Embedder | None = None, files: DataFrame | None = None) -> tuple[dict, int, int]:
    """Put `fresh` chunks in the place of the `stale` ones of an index; its manifest, and how many came and went.

    Chunks that are among both stay as they are; only others are tokenised and embedded.  Chunks that are gone
    leave all tables, and the terms follow from the old corpus counts, those of the gone chunks taken out and those of the
    added ones put in.  The new tables are written beside the old ones; while they are put in their place there is no
    manifest, so an index that was left half-way is built anew.
    """
    manifest = read_json(spark, f"{path}/manifest.json")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    marked = lambda frame: frame.select(*CHUNK_COLUMNS, row_digest(*map(F.col, CHUNK_COLUMNS)).alias("mark"))
    fresh, stale = stored(marked(fresh)), marked(stale)
    gone = stored(stale.join(fresh, ["id", "mark"], "left_anti").select("id", "mark"))
    new = stored(fresh.join(stale, ["id", "mark"], "left_anti").select(*CHUNK_COLUMNS))
    lost = gone.select(F.col("id").alias("doc_id"))
    stage = f"{path}/.update-{uuid.uuid4().hex}"
    marked(read("chunks")).join(gone, ["id", "mark"], "left_anti").select(*CHUNK_COLUMNS).unionByName(new).write.parquet(f"{stage}/chunks")
    chunks = spark.read.parquet(f"{stage}/chunks")
    count = chunks.count()
    if not count:
        remove_path(spark, stage)
        raise ValueError("no chunks to index")
    unseen = stored(dense.embed_missing(new, read("embedding_cache"), manifest["model_name"], embedder)[1])  # embedded once
    vectors, _ = dense.embed_missing(new, read("embedding_cache").unionByName(unseen), manifest["model_name"], embedder)
    read("vectors").join(lost.withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "left_anti").unionByName(vectors).write.parquet(f"{stage}/vectors")
    sparse.counted_documents(new.select(F.col("id").alias("doc_id"), sparse.chunk_document().alias("text"))).write.parquet(f"{stage}/added")
    counted = spark.read.parquet(f"{stage}/added")
    read("counted").join(lost, "doc_id", "left_anti").unionByName(counted).write.parquet(f"{stage}/counted")
    leaving = sparse.corpus_counts(read("counted").join(lost, "doc_id", "left_semi"))
    write_terms(spark, sparse.merged_counts(read("counts"), sparse.negated(leaving), sparse.corpus_counts(counted)), stage)
    names = ["chunks", "vectors", "counted", "counts", "stats", "terms"]
    if files is not None:
        files.write.parquet(f"{stage}/files")
        names.append("files")
    manifest |= {"built_at": datetime.now(UTC).isoformat(), "chunk_count": count, "fingerprint": fingerprint(chunks)}
    remove_path(spark, f"{path}/manifest.json")
    remove_path(spark, f"{path}/graph")  # of vectors that are no more; write_graph makes it anew
    for name in names:
        remove_path(spark, f"{path}/{name}")
        move(spark, f"{stage}/{name}", f"{path}/{name}")
    unseen.select("model_name", "chunk_id", "text_sha256", "embedding").write.mode("append").parquet(f"{path}/embedding_cache")
    remove_path(spark, stage)
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
    return manifest, new.count(), gone.count()


def load_or_build(spark: SparkSession, repository: str, path: str, **options) -> dict:
    """The manifest of an index that fits the repository's present chunks: the stored one, brought up to the files that
    changed; built anew if there is none of this version, repository and options."""
    if exists(spark, f"{path}/manifest.json"):
        manifest = read_json(spark, f"{path}/manifest.json")
        asked = {{"overlap": "chunk_overlap_lines", "model": "model_name"}.get(k, k): list(v) if isinstance(v, tuple) else v for k, v in options.items() if k != "embedder"}
        if manifest["version"] == VERSION and manifest["repository"] == repository and all(manifest.get(k) == v for k, v in asked.items()):
            return update_index(spark, path, options.get("embedder"))[0]
    return build_index(spark, repository, path, **options)


def append_jsonl(rows: DataFrame, path: str | None) -> None:
    """Rows as JSON lines behind those that are there; no path: nothing."""
    if path and path.strip().lower() not in ("none", "null"):
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def timestamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def elapsed_ms(since: float) -> float:
    """Milliseconds since a reading of time.perf_counter, with three places."""
    return round((time.perf_counter() - since) * 1000, 3)


def log_records(answers: DataFrame) -> DataFrame:
    """What is logged of answers, with the time."""
    return answers.select(timestamp().alias("timestamp"), *answers.columns)


def run_records(answers: DataFrame, passes: DataFrame, top_k: int, latency_ms: Column | None = None) -> DataFrame:
    """The run log's records of answers (query_id, question, answer, mode, partial_answer) and their passes
    (query_id, pass, query, chunks, retrieval_ms, generation_ms): both passes' traces, chunks by five fields."""
    trace = F.struct("query", chunk_summary(F.col("chunks")).alias("retrieved_chunks"), "retrieval_ms", "generation_ms")
    each = passes.groupBy("query_id").agg(*[F.max_by(trace, F.when(F.col("pass") == n, 1)).alias(f"pass_{n}") for n in (1, 2)])
    joined = answers.join(each, "query_id", "left")
    return joined.select(
        timestamp().alias("timestamp"), "mode", F.col("question").alias("query"), F.lit(top_k).alias("top_k"), "pass_1", "pass_2", "partial_answer", "answer",
        (F.lit(None).cast("double") if latency_ms is None else latency_ms).alias("latency_ms"),
    )


def confidence_records(judged: DataFrame, samples: DataFrame, pairs: DataFrame, threshold: float, temperatures: tuple[float, ...]) -> DataFrame:
    """The confidence log's records: each question's verdict with its sampled answers and their pairs' scores."""
    raw = samples.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "answer"))), lambda x: x["answer"]).alias("raw_answers"))
    scored = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("left", "right", "lexical", "semantic", "combined"))).alias("pair_scores"))
    whole = judged.join(raw, "query_id", "left").join(scored, "query_id", "left")
    return whole.select(timestamp().alias("timestamp"), F.lit(threshold).alias("threshold"), F.array(*map(F.lit, temperatures)).alias("temperatures"), *whole.columns)


def write_ablation(records: DataFrame, report: DataFrame, path: str) -> None:
    """An ablation's records and report as JSON lines below `path`."""
    records.write.mode("overwrite").json(f"{path}/records")
    report.write.mode("overwrite").json(f"{path}/report")


def read_ablation(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """Records to judge (condition_id, id, question, answer, expected_refusal, ground_truth_answer): from tables
    that `write_ablation` wrote, or from one JSON document of conditions with their records."""
    if exists(spark, f"{path}/records"):
        rows = spark.read.json(f"{path}/records")
    else:
        document = spark.read.option("multiLine", True).json(path)
        if "conditions" not in document.columns:
            raise ValueError("the document has no list of conditions")
        each = document.select(F.explode("conditions").alias("c")).filter("c.metrics.records IS NOT NULL")
        rows = each.select(F.col("c.condition.id").alias("condition_id"), F.explode("c.metrics.records").alias("r")).select("condition_id", "r.*")
    own = items.select("id", F.col("question").alias("__q"), "ground_truth_answer", F.col("expected_refusal").alias("__e"))
    rows = rows.drop("ground_truth_answer").join(own, "id")
    asked = F.coalesce("question", "__q") if "question" in rows.columns else F.col("__q")
    refuse = F.coalesce("expected_refusal", "__e") if "expected_refusal" in rows.columns else F.col("__e")
    return rows.select("condition_id", "id", asked.alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), refuse.alias("expected_refusal"), "ground_truth_answer")


def judge_ablation(spark: SparkSession, path: str, items: DataFrame, judge_fn: evaluation.Judge, out: str) -> DataFrame:
    """Judge a stored ablation: records as JSON lines and the summary as CSV below `out`; the summary is returned."""
    judged = stored(evaluation.lexical_baselines(evaluation.judge(read_ablation(spark, path, items), judge_fn)))
    judged.write.mode("overwrite").json(f"{out}/records")
    summary = evaluation.judge_summary(judged, "condition_id").orderBy("condition_id")
    write_report(summary, f"{out}/summary")
    return summary


def report_rows(report: DataFrame) -> DataFrame:
    """A report as strings: floats with six places, nulls empty."""
    shape = lambda n, t: F.when(F.col(n).isNotNull(), fixed(F.col(n), 6)) if t in ("double", "float") else F.col(n).cast("string")
    return report.select(*[F.coalesce(shape(n, t), F.lit("")).alias(n) for n, t in report.dtypes])


def write_report(report: DataFrame, path: str) -> None:
    report_rows(report).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def report_table(spark: SparkSession, path: str) -> DataFrame:
    """A written report, all strings; what was null is empty."""
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


def read_report(spark: SparkSession, path: str) -> dict[str, dict]:
    """The rows of a small report by condition."""
    return {r.condition_id: r.asDict() for r in report_table(spark, path).collect()}


def write_raw_files(files: DataFrame, path: str) -> None:
    files.select("filepath", "raw_content").write.mode("overwrite").json(path)
