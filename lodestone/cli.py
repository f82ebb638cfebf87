"""Command line: ingest, chunk, build, dense, sparse, search, answer, generate, evaluate, ablation, judge."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answering, chunking, clients, dense, evaluation, sparse
from .operators.ordering import positions
from .operators.records import fixture_chunks, metric_text
from .plans import store
from .plans.search import Engine
from .session import stored
from .sources.repository import read_eval_set, read_repository


def parsed(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "chunk", "build"):
        one = commands.add_parser(name)
        one.add_argument("repository")
        one.add_argument("--out")
        one.add_argument("--max-lines", type=int, default=500 if name == "ingest" else None)
        one.add_argument("--include", action="append", default=[])
        one.add_argument("--exclude", action="append", default=[])
        one.add_argument("--exclude-tests", action="store_true")
        one.add_argument("--reuse", action="store_true")
    for name in ("dense", "sparse"):
        one = commands.add_parser(name, help="index a repository for one kind of search, and try it")
        one.add_argument("repository")
        one.add_argument("--out", default="index")
        one.add_argument("--query")
        one.add_argument("--top-k", type=int, default=5)
        one.add_argument("--max-lines", type=int, default=220)
        one.add_argument("--include", action="append", default=[])
        one.add_argument("--exclude", action="append", default=[])
        one.add_argument("--exclude-tests", action="store_true")
        one.add_argument("--force-rebuild", action="store_true")
    generate = commands.add_parser("generate", help="answer a question from a few built-in snippets or those of a file")
    generate.add_argument("question")
    generate.add_argument("--chunks", help="JSON lines of chunks; without them the built-in ones")
    generate.add_argument("--temperature", type=float, default=0.0)
    generate.add_argument("--json", action="store_true")
    _model(generate)
    for name in ("search", "answer", "evaluate", "ablation"):
        one = commands.add_parser(name)
        one.add_argument("index")
        one.add_argument("--top-k", type=int, default=5 if name == "search" else 7)
        if name in ("search", "answer"):
            one.add_argument("question", nargs="+")
        else:
            one.add_argument("test_set")
            one.add_argument("--out")
            one.add_argument("--oracle", action="store_true", help="score the truth itself")
        if name != "ablation":
            one.add_argument("--retrieval", default="hybrid", choices=["dense", "bm25", "hybrid"])
        if name != "search":
            one.add_argument("--mode", default="iterative", choices=["single", "iterative"])
            one.add_argument("--confidence", action="store_true")
            one.add_argument("--log")
            _model(one)
    judge = commands.add_parser("judge")
    judge.add_argument("ablation")
    judge.add_argument("test_set")
    judge.add_argument("--out", required=True)
    _model(judge)
    return parser.parse_args(argv)


def _model(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--base-url", default="http://localhost:11434/v1")
    parser.add_argument("--model", default="local")
    parser.add_argument("--api-key", default="")


def judge_by(client) -> evaluation.Judge:
    """A judge that asks a model for numbers as JSON."""

    def judge(row: dict) -> dict:
        told = (
            "Score the answer against the expected one. Reply with a JSON object of numbers from 0 to 1: answer_correctness, faithfulness, refusal_quality.\n"
            f"Question: {row['question']}\nExpected: {row['ground_truth_answer']}\nTo be refused: {row['expected_refusal']}\nAnswer: {row['answer']}"
        )
        text = client([told], [row["question"]], 0.0)[0]
        return json.loads(text[text.index("{") : text.rindex("}") + 1])

    return judge


def show(frame: DataFrame) -> None:
    for line in frame.toJSON().toLocalIterator():
        print(line)


def print_summary(report: DataFrame) -> None:
    """A line for each condition."""
    for r in report.select("condition_id", "label", *[metric_text(F.col(c)).alias(c) for c in ("context_hit_rate", "answer_relevance_proxy", "adversarial_refusal_rate")]).collect():  # four rows
        print(f"{r.condition_id} {r.label}: context hits {r.context_hit_rate}, answers {r.answer_relevance_proxy}, refusals {r.adversarial_refusal_rate}")


def main(argv: list[str] | None = None, client=None) -> int:
    """Run a command; `client` takes the place of the chat service."""
    args = parsed(argv)
    spark = SparkSession.builder.getOrCreate()
    if hasattr(args, "base_url"):
        client = client or clients.ChatClient(args.base_url, args.model, args.api_key)
    if args.command in ("ingest", "chunk", "build"):
        return repository_command(spark, args)
    if args.command in ("dense", "sparse"):
        return index_command(spark, args)
    if args.command == "generate":
        return generate_command(spark, args, client)
    if args.command == "judge":
        show(store.judge_ablation(spark, args.ablation, read_eval_set(spark, args.test_set), judge_by(client), args.out))
        return 0
    engine = Engine(spark, args.index)
    asked = lambda texts: spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(texts)], "query_id string, question string")
    if args.command == "search":
        search = {"dense": engine.query_dense, "bm25": engine.query_bm25, "hybrid": engine.hybrid}[args.retrieval]
        places = engine.chunks.select(F.col("id").alias("doc_id"), "filepath", "function_name", "start_line", "end_line")
        show(search(asked(args.question), args.top_k).join(places, "doc_id").orderBy("query_id", "rank"))
        return 0
    if args.command == "answer":
        out = engine.answer(asked(args.question), client, args.mode, args.retrieval, args.top_k, args.confidence)
        store.append_jsonl(store.log_records(out), args.log)
        show(out.orderBy("query_id"))
        return 0
    items = read_eval_set(spark, args.test_set)
    if args.command == "evaluate":
        if args.oracle:
            outputs = evaluation.oracle_answers(items)
        else:
            outputs = engine.answer(items.select(F.col("id").alias("query_id"), "question"), client, args.mode, args.retrieval, args.top_k, args.confidence).drop("question").withColumnRenamed("query_id", "id")
        records = evaluation.score_items(items, outputs)
        if args.out:
            records.write.mode("overwrite").json(args.out)
        show(evaluation.summary(records))
        return 0
    records, report = evaluation.run_conditions(items, lambda queries: engine.answer_conditions(queries, client, args.top_k, args.confidence))
    if args.out:
        store.write_ablation(records, report, args.out)
        store.write_report(report, f"{args.out}/summary")
        report = spark.read.schema(report.schema).json(f"{args.out}/report").orderBy("condition_id")
    print_summary(report)
    return 0


def index_command(spark: SparkSession, args: argparse.Namespace) -> int:
    """One kind of index of a repository's chunks; its hits for a question, with their places."""
    options = {"include": args.include, "exclude": args.exclude, "exclude_tests": args.exclude_tests, "max_chunk_lines": args.max_lines, "chunk_overlap_lines": 20}
    folder = f"{args.out}/{args.command}"
    chunks = stored(store.chunks_of(read_repository(spark, args.repository, all_folders=True), options))
    fingerprint = store.fingerprint(chunks)
    known = store.read_json(spark, f"{folder}/manifest.json") if store.exists(spark, f"{folder}/manifest.json") else {}
    fits = not args.force_rebuild and (known.get("version"), known.get("fingerprint")) == (store.VERSION, fingerprint)
    if not fits:
        store.remove_path(spark, f"{folder}/manifest.json")
        if args.command == "dense":
            store.write_vectors(chunks, folder, anew=args.force_rebuild)
        else:
            store.write_counted(chunks, folder)
        store.write_text(spark, f"{folder}/manifest.json", json.dumps({"version": store.VERSION, "fingerprint": fingerprint, "chunk_count": chunks.count()}))
    print(json.dumps({"chunks": chunks.count(), "rebuilt": not fits}, sort_keys=True))
    if args.query and args.query.strip():
        asked = spark.createDataFrame([("q", args.query)], "query_id string, question string")
        if args.command == "dense":
            hits = dense.knn_topk(spark.read.parquet(f"{folder}/vectors"), dense.embed(asked, "question"), args.top_k, key="chunk_id")
        else:
            hits = sparse.bm25_topk(store.load_sparse(spark, folder), asked, args.top_k)
        places = chunks.select(F.col("id").alias("doc_id"), "filepath", "function_name", "start_line", "end_line")
        show(hits.join(places, "doc_id").drop("query_id").orderBy("rank"))
    return 0


def generate_command(spark: SparkSession, args: argparse.Namespace, client) -> int:
    """One answer from given chunks, in their order."""
    built_in = fixture_chunks(spark)
    chunks = spark.read.schema(built_in.schema).json(args.chunks) if args.chunks else built_in
    ordered = positions(chunks.select("id", "filepath", "start_line", "end_line", "function_name"), *chunking.corpus_order(), F.asc("id"))
    hits = ordered.select(F.lit("q").alias("query_id"), "position", F.col("id").alias("doc_id"))
    asked = spark.createDataFrame([("q", args.question)], "query_id string, question string").join(answering.contexts(hits, chunks), "query_id", "left")
    answer = stored(answering.generate(asked, client, args.temperature)).first().answer
    print(json.dumps({"query": args.question, "answer": answer}) if args.json else answer)
    return 0


def repository_command(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "build":
        run = store.load_or_build if args.reuse else store.build_index
        manifest = run(spark, args.repository, args.out or "index", include=tuple(args.include), exclude=tuple(args.exclude), exclude_tests=args.exclude_tests, **({"max_chunk_lines": args.max_lines} if args.max_lines else {}))
        print(json.dumps(manifest, sort_keys=True))
        return 0
    files = chunking.ingest(read_repository(spark, args.repository, all_folders=args.command == "chunk"), args.max_lines or 500)
    if args.command == "ingest":
        kept = files.filter("skip_reason IS NULL")
        if args.out:
            store.write_raw_files(kept, args.out)
        print(json.dumps({"files": kept.count(), "skipped": {r.reason: r.files for r in chunking.skip_counts(files).collect()}}, sort_keys=True))
    else:
        chunks = chunking.filter_paths(chunking.chunk_files(files, args.max_lines), tuple(args.include), tuple(args.exclude), args.exclude_tests)
        if args.out:
            chunks.write.mode("overwrite").json(args.out)
        else:
            show(chunks.orderBy(*chunking.corpus_order()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
