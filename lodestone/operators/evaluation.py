"""Scores of answers against a test set, ablation over conditions, and judging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import bleu1, context_hit, context_precision, context_recall, missing, rouge1, rouge_l, token_overlap
from ..functions.text import REFUSAL_ANSWER, clamp, is_refusal
from ..schema import JUDGE_SCORES


@dataclass(frozen=True)
class Condition:
    id: str
    label: str
    retrieval: str
    retrieval_passes: str
    mode: str


#: The four conditions and the report's columns.
CONDITIONS = (
    Condition("A", "Dense only, single-pass", "dense", "single-pass", "single"),
    Condition("B", "Hybrid, single-pass", "hybrid", "single-pass", "single"),
    Condition("C", "Dense only, iterative", "dense", "iterative (2-pass)", "iterative"),
    Condition("D", "Hybrid, iterative", "hybrid", "iterative (2-pass)", "iterative"),
)
REPORT_FIELDS = (
    "condition_id label retrieval retrieval_passes mode total_questions answerable_questions refusal_questions context_hit_rate "
    "context_recall context_precision answer_relevance_proxy refusal_accuracy adversarial_queries adversarial_refusal_rate "
    "avg_confidence low_confidence_rate"
).split()


#: What an ablation's query ids begin with.
ITEM, PROBE = "item:", "probe:"

#: Questions that no code base answers.
ADVERSARIAL_QUERIES = (
    "In which file is the moon's phase written to the printer?",
    "What does the function that pays the staff's pensions return?",
    "Which class steers the harbour crane at night?",
)


def conditions(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in (("condition_id", c.id), ("label", c.label), ("retrieval", c.retrieval), ("retrieval_passes", c.retrieval_passes), ("mode", c.mode))]) for c in CONDITIONS])
    return spark.range(1).select(F.inline(rows))


def score_items(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """Items (id, question, ...) with their outputs (id, answer, contexts) and the scores of each; an item without output raises.
    With a condition_id in the outputs every item has one for each condition."""
    wanted = items.crossJoin(F.broadcast(conditions(items.sparkSession).select("condition_id"))) if "condition_id" in outputs.columns else items  # four rows
    lost = wanted.join(outputs, [c for c in ("id", "condition_id") if c in wanted.columns], "left_anti").count()
    if lost:
        raise ValueError(f"{lost} items have no output")
    expected, actual = F.col("ground_truth_context"), F.coalesce("contexts", F.array().cast("array<struct<filepath:string,function_name:string>>"))
    answerable = ~F.col("expected_refusal")
    scored = items.join(outputs, "id")
    return scored.select(
        "*",
        F.when(answerable, context_hit(expected, actual)).alias("context_hit"),
        F.when(answerable, context_recall(expected, actual)).alias("context_recall"),
        F.when(answerable, context_precision(expected, actual)).alias("context_precision"),
        F.when(answerable, token_overlap(F.col("answer"), F.col("ground_truth_answer"))).alias("answer_token_overlap"),
        F.when(F.col("expected_refusal"), is_refusal(F.col("answer"))).alias("refusal_correct"),
        missing(expected, actual).alias("missing_contexts"),
    )


def mean(column: str | Column) -> Column:
    """Mean without nulls; booleans count as 0 and 1."""
    return F.avg((F.col(column) if isinstance(column, str) else column).cast("double"))


def summary(records: DataFrame, *by: str) -> DataFrame:
    """Counts and means of scored items."""
    return records.groupBy(*by).agg(
        F.count("*").alias("total_questions"),
        F.count_if(~F.col("expected_refusal")).alias("answerable_questions"),
        F.count_if("expected_refusal").alias("refusal_questions"),
        mean("context_hit").alias("context_hit_rate"),
        mean("context_recall").alias("context_recall"),
        mean("context_precision").alias("context_precision"),
        mean("answer_token_overlap").alias("answer_relevance_proxy"),
        mean("refusal_correct").alias("refusal_accuracy"),
    )


def adversarial_queries(items: DataFrame, extra: tuple[str, ...] = ADVERSARIAL_QUERIES) -> DataFrame:
    """query_id, question: the refusal questions and the standing ones, each once, first seen first."""
    from .fusion import first_seen

    own = items.filter("expected_refusal").select(F.concat(F.lit("0"), "id").alias("at"), "question")
    standing = items.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, extra))).alias("i", "question")).select(F.concat(F.lit("1"), F.lpad(F.col("i").cast("string"), 9, "0")).alias("at"), "question")
    return first_seen(own.unionByName(standing), F.col("question"), [F.asc("at")]).select(F.concat(F.lit("adversarial-"), "at").alias("query_id"), "question")


def refused_or_flagged(answer: Column, low_confidence: Column, grounded: Column) -> Column:
    return is_refusal(answer) | F.coalesce(low_confidence, F.lit(False)) | ~F.coalesce(grounded, F.lit(True))


def oracle_answers(items: DataFrame) -> DataFrame:
    """Each item's own truth as if it were an output (id, answer, contexts): scores of these must be perfect."""
    answer = F.when(F.col("expected_refusal"), REFUSAL_ANSWER).otherwise(F.col("ground_truth_answer"))
    return items.select("id", answer.alias("answer"), F.col("ground_truth_context").alias("contexts"))


def external_means(scores: DataFrame, *by: str, prefix: str = "external_") -> DataFrame:
    """Means of the numeric columns of an outside scorer's rows."""
    numeric = [n for n, t in scores.dtypes if n not in by and t.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
    return scores.groupBy(*by).agg(*[mean(n).alias(prefix + n) for n in numeric])


def report_fields(report: DataFrame) -> list[str]:
    """The report's columns: the fixed ones, then whatever else there is by name."""
    return [*REPORT_FIELDS, *sorted(c for c in report.columns if c not in REPORT_FIELDS)]


def probes_of(items: DataFrame) -> DataFrame:
    """query_id, question of what an ablation asks: the items, and the questions that are to be refused."""
    own = items.select(F.concat(F.lit(ITEM), "id").alias("query_id"), "question")
    return own.unionByName(adversarial_queries(items).select(F.concat(F.lit(PROBE), "query_id").alias("query_id"), "question"))


def ablation_report(items: DataFrame, outputs: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and summary by condition, from the outputs of all conditions in one frame: condition_id, query_id (of
    `probes_of`), answer, contexts, grounded, and, if judged, confidence and should_refuse."""
    for name, kind in (("confidence", "double"), ("should_refuse", "boolean")):
        outputs = outputs if name in outputs.columns else outputs.withColumn(name, F.lit(None).cast(kind))
    outputs = outputs.drop("question")
    named = lambda prefix: outputs.filter(F.col("query_id").startswith(prefix)).withColumn("query_id", F.substring("query_id", len(prefix) + 1, 1 << 30))
    records = score_items(items, named(ITEM).withColumnRenamed("query_id", "id"))
    attacks = named(PROBE)
    flagged = refused_or_flagged(F.col("answer"), F.col("should_refuse"), F.col("grounded"))
    rates = attacks.groupBy("condition_id").agg(F.count("*").alias("adversarial_queries"), mean(flagged).alias("adversarial_refusal_rate"))
    trust = records.groupBy("condition_id").agg(mean("confidence").alias("avg_confidence"), mean("should_refuse").alias("low_confidence_rate"))
    report = conditions(items.sparkSession).join(summary(records, "condition_id"), "condition_id").join(rates, "condition_id").join(trust, "condition_id")
    if scorer is not None:
        report = report.join(external_means(scorer(records), "condition_id"), "condition_id", "left")
    return records, report.select(*report_fields(report)).orderBy("condition_id")


def run_conditions(items: DataFrame, answer: Callable[[DataFrame], DataFrame], scorer: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """An ablation as one plan: `answer` gets all questions (query_id, question) once and gives the outputs of all conditions
    with their condition_id (`answering.answer_conditions` shares retrieval and first passes between them)."""
    return ablation_report(items, answer(probes_of(items)), scorer)


def run_ablation(items: DataFrame, pipelines: Mapping[str, Callable[[DataFrame], DataFrame]], scorer: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The same with a pipeline of its own for each condition id: questions (query_id, question) to answers (query_id,
    answer, contexts, grounded, and, if judged, confidence and should_refuse)."""
    asked = probes_of(items)
    outputs = [pipelines[c.id](asked).withColumn("condition_id", F.lit(c.id)) for c in CONDITIONS]
    return ablation_report(items, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outputs), scorer)


def lexical_baselines(records: DataFrame, answer: str = "answer", truth: str = "ground_truth_answer") -> DataFrame:
    """Records with rouge1_f1, rougeL_f1 and bleu; null for questions to be refused."""
    a, t, asked = F.col(answer), F.col(truth), ~F.col("expected_refusal")
    return records.withColumns({"rouge1_f1": F.when(asked, rouge1(a, t)), "rougeL_f1": F.when(asked, rouge_l(a, t)), "bleu": F.when(asked, bleu1(a, t))})


Judge = Callable[[dict], Mapping[str, float]]


def judge(records: DataFrame, judge_fn: Judge) -> DataFrame:
    """Records with a judge's scores within [0, 1]; what a judge raises becomes the record's error."""
    inputs = ["id", "question", "answer", "ground_truth_answer", "expected_refusal"]

    @F.pandas_udf(JUDGE_SCORES)
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                try:
                    found = dict(judge_fn(row))
                    out.append({**{n: found.get(n) for n in JUDGE_SCORES.names[:-1]}, "error": None})
                except Exception as error:  # a record's failure is its result
                    out.append({**dict.fromkeys(JUDGE_SCORES.names[:-1]), "error": f"{type(error).__name__}: {error}"})
            frame = pd.DataFrame(out, columns=JUDGE_SCORES.names)
            for n in JUDGE_SCORES.names[:-1]:
                frame[n] = pd.to_numeric(frame[n], errors="coerce")
            yield frame

    scored = records.withColumn("__s", call.asNondeterministic()(F.struct(*inputs)))
    return scored.select("*", *[clamp(F.col(f"__s.{n}")).alias(n) for n in JUDGE_SCORES.names[:-1]], F.col("__s.error").alias("error")).drop("__s")


def judge_summary(judged: DataFrame, *by: str) -> DataFrame:
    scores = [n for n in (*JUDGE_SCORES.names[:-1], "rouge1_f1", "rougeL_f1", "bleu") if n in judged.columns]
    return judged.groupBy(*by).agg(*[mean(n).alias(n) for n in scores], F.count_if(F.col("error").isNotNull()).alias("errors"))


def external_scores(records: DataFrame, scorer: Callable[[DataFrame], Mapping[str, float]] | None) -> dict:
    """An optional outside scorer; without one, or if it fails, only the reason."""
    if scorer is None:
        return {"enabled": False, "reason": "no scorer installed"}
    try:
        return {"enabled": True, "scores": dict(scorer(records))}
    except Exception as error:  # the report does without it
        return {"enabled": False, "reason": str(error)}
