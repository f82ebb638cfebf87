"""Prompts within a budget, guarded answers, a second pass, agreement of samples, grounding.

Every step takes all questions at once.  Models are callables on lists, called with Arrow
batches; whatever depends on a model's answer reads a stored table, not the model again.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REFUSAL_ANSWER, clamp, cosine, fixed, invalid_citations, limit_text, missing_identifiers, shared_words, strip, text_or_empty, ungrounded_claims, word_set
from ..session import stored

#: Limits in characters, and what stands between rendered chunks.
MAX_CONTEXT_CHARS, MAX_CHUNK_CHARS = 24_000, 8_000
SEPARATOR = "\n\n---\n\n"
#: Agreement.
TEMPERATURES = (0.0, 0.5, 0.9)
THRESHOLD, MEDIUM_BELOW = 0.72, 0.15
LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 0.4, 0.6

#: What a model is told before each question.
SYSTEM_PROMPT = (
    "You answer questions about a code base from numbered source snippets, and from nothing else. "
    f'If the snippets do not hold the answer, reply exactly: "{REFUSAL_ANSWER}" '
    "Name only files, functions, classes and behaviour that the snippets show; add no general knowledge and invent nothing. "
    "Write at most six short bullets, each with the numbers of the snippets it rests on, like [1]. "
    "Where the snippets answer in part, say which part they leave open."
)

Generator = Callable[..., list[str]]
Similarity = Callable[[list[str]], list[float]]


def render_chunk(position: Column, max_chunk_chars: int | None = MAX_CHUNK_CHARS) -> Column:
    """A numbered chunk as it stands in the prompt."""
    header = F.concat(F.lit("["), position.cast("string"), F.lit("] "), F.col("filepath"), F.lit("::"), F.col("function_name"), F.lit(" lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    doc = F.when(text_or_empty(F.col("docstring")) != "", F.concat(F.lit("Docstring: "), F.col("docstring")))
    return F.concat_ws("\n", header, doc, F.lit("Source:"), limit_text(text_or_empty(F.col("source")), max_chunk_chars))


def within_budget(blocks: DataFrame, limit: int | None = MAX_CONTEXT_CHARS, group: str = "query_id", position: str = "position", block: str = "block") -> DataFrame:
    """The first blocks of each group that fit together; the first one is shortened if it doesn't fit alone."""
    if limit is None:
        return blocks
    before = Window.partitionBy(group).orderBy(position)
    used = F.sum(F.length(block) + len(SEPARATOR)).over(before) - len(SEPARATOR)
    marked = blocks.withColumn("__used", used).withColumn("__first", F.row_number().over(before) == 1)
    # the running length only grows, so what is beyond the limit is a suffix
    fits = marked.filter((F.col("__used") <= limit) | F.col("__first"))
    return fits.withColumn(block, F.when(F.col("__first"), limit_text(F.col(block), limit)).otherwise(F.col(block))).drop("__used", "__first")


def contexts(hits: DataFrame, chunks: DataFrame, max_context_chars: int | None = MAX_CONTEXT_CHARS, max_chunk_chars: int | None = MAX_CHUNK_CHARS) -> DataFrame:
    """query_id, context, n_chunks, allowed, contexts of hits (query_id, position, doc_id): the prompt's
    snippets, how many there are, the text that claims are held against, and where all hits come from."""
    rows = hits.select("query_id", "position", F.col("doc_id").alias("id")).join(chunks, "id")
    blocks = rows.withColumn("block", render_chunk(F.col("position"), max_chunk_chars))
    kept = within_budget(blocks, max_context_chars).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "block"))).alias("b"))
    prompt = kept.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), SEPARATOR).alias("context"), F.size("b").alias("n_chunks"))
    whole = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "source", "function_name", "filepath"))).alias("r"))
    allowed = whole.select(
        "query_id",
        F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["source"], x["function_name"], x["filepath"])), " ").alias("allowed"),
        F.transform("r", lambda x: F.struct(x["filepath"].alias("filepath"), x["function_name"].alias("function_name"))).alias("contexts"),
    )
    return prompt.join(allowed, "query_id")


def user_message(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nSource snippets:\n"), context, F.lit("\n\nEvery bullet of the answer cites the snippets above that it comes from."))


def guarded(answer: Column, question: Column, n_chunks: Column) -> Column:
    """The stripped answer, or the refusal: without snippets, if blank, without or with wrong citations, or if an identifier of the question is missing."""
    clean = strip(text_or_empty(answer))
    refused = (F.coalesce(n_chunks, F.lit(0)) == 0) | (clean == "") | invalid_citations(clean, n_chunks) | (F.size(missing_identifiers(question, clean)) > 0)
    return F.when(F.coalesce(refused, F.lit(True)), F.lit(REFUSAL_ANSWER)).otherwise(clean)


def takes_system(generator: Generator) -> bool:
    try:
        return "system" in inspect.signature(generator).parameters
    except (TypeError, ValueError):
        return False


def generate(asked: DataFrame, generator: Generator, temperature: float = 0.0, system: str = SYSTEM_PROMPT) -> DataFrame:
    """asked (query_id, question, context, n_chunks, ...) with `answer`; rows without snippets never reach
    the generator.  It is called with messages, questions and the temperature; the system prompt comes as
    `system` if it has such a parameter, else at the head of each message."""
    apart = takes_system(generator)

    @F.pandas_udf("string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for messages, questions in batches:
            told = messages.tolist() if apart else [f"{system}\n\n{m}" for m in messages]
            answers = generator(told, questions.tolist(), temperature, **({"system": system} if apart else {}))
            yield pd.Series(list(answers), dtype=object)

    call = call.asNondeterministic()
    can = F.coalesce(F.col("n_chunks"), F.lit(0)) > 0
    told = asked.filter(can).withColumn("__raw", call(user_message(F.col("context"), F.col("question")), F.col("question")))
    told = told.withColumn("answer", guarded(F.col("__raw"), F.col("question"), F.col("n_chunks"))).drop("__raw")
    return told.unionByName(asked.filter(~can).withColumn("answer", F.lit(REFUSAL_ANSWER)))


def refined_question(question: Column, partial: Column) -> Column:
    """The second pass's query: the question and what was answered so far."""
    return F.concat(question, F.lit("\n\nPartial answer:\n"), partial)


def answer_questions(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], chunks: DataFrame, generator: Generator, mode: str = "iterative", store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """query_id, question, answer, mode, passes, partial_answer, contexts, grounded, ungrounded_claims.

    `retrieve` takes questions (query_id, question) and gives hits (query_id, position, doc_id).
    In iterative mode the questions answered in the first pass go through a second one."""
    if mode not in ("single", "iterative"):
        raise ValueError(f"unknown mode {mode}")
    return passes(queries, retrieve, chunks, generator, (mode,), store)[mode]


def passes(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], chunks: DataFrame, generator: Generator, modes: tuple[str, ...], store: Callable[[DataFrame], DataFrame] = stored) -> dict[str, DataFrame]:
    """The answers of each mode; all modes share the first pass."""

    def one_pass(asked: DataFrame, searched: DataFrame) -> DataFrame:
        found = contexts(retrieve(searched), chunks)
        return store(generate(asked.join(found, "query_id", "left"), generator))

    def checked(final: DataFrame, mode: str) -> DataFrame:
        claims = ungrounded_claims(F.col("answer"), F.col("allowed"))
        final = final.withColumn("ungrounded_claims", claims).withColumn("grounded", F.size("ungrounded_claims") == 0).withColumn("mode", F.lit(mode))
        return final.select("query_id", "question", "answer", "mode", "passes", "partial_answer", "contexts", "n_chunks", "grounded", "ungrounded_claims")

    base = queries.select("query_id", "question")
    first = one_pass(base, base)
    out = {"single": checked(first.withColumns({"passes": F.lit(1), "partial_answer": F.lit(None).cast("string")}), "single")}
    if "iterative" in modes:
        again = first.filter(F.col("answer") != REFUSAL_ANSWER).select("query_id", "question", F.col("answer").alias("partial_answer"))
        searched = again.select("query_id", refined_question(F.col("question"), F.col("partial_answer")).alias("question"))
        second = one_pass(again, searched).withColumn("passes", F.lit(2))
        skipped = first.filter(F.col("answer") == REFUSAL_ANSWER).withColumns({"passes": F.lit(1), "partial_answer": F.col("answer")})
        out["iterative"] = checked(second.unionByName(skipped, allowMissingColumns=True), "iterative")
    return out


def answer_conditions(queries: DataFrame, retrieve: Mapping[str, Callable[[DataFrame], DataFrame]], chunks: DataFrame, generator: Generator, conditions: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """The answers of all conditions (condition_id, retrieval, mode: a few rows) in one frame, with condition_id.

    Questions are asked once for each kind of retrieval, with the kind in their id; conditions that differ in the mode alone
    share retrieval and first pass, and second passes of all kinds go through one plan."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}/"), c)
    kinds = list(retrieve)

    def all_kinds(asked: DataFrame) -> DataFrame:
        hits = []
        for kind in kinds:
            own = asked.filter(F.col("query_id").startswith(f"{kind}/")).withColumn("query_id", F.substring("query_id", len(kind) + 2, 1 << 30))
            hits.append(retrieve[kind](own).select("query_id", "position", "doc_id").withColumn("query_id", named(kind, F.col("query_id"))))
        return reduce(lambda a, b: a.unionByName(b), hits)

    asked = queries.select(F.explode(F.array(*[named(kind, F.col("query_id").cast("string")) for kind in kinds])).alias("query_id"), "question")
    both = passes(asked, all_kinds, chunks, generator, ("single", "iterative"), store)
    answers = both["single"].unionByName(both["iterative"])
    answers = answers.withColumns({"retrieval": F.substring_index("query_id", "/", 1), "query_id": F.expr("substring(query_id, instr(query_id, '/') + 1)")})
    return answers.join(F.broadcast(conditions.select("condition_id", "retrieval", "mode")), ["retrieval", "mode"]).drop("retrieval")


def agreement_pairs(samples: DataFrame, group: str = "query_id", order: str = "sample", answer: str = "answer", semantic: Callable[[Column, Column], Column] | None = None, features: Callable[[Column], Column] | None = None) -> DataFrame:
    """group, left, right, lexical, semantic, combined for every two samples of a group (the samples of one question are few by construction).
    Words, and `features` of an answer where `semantic` compares those, are worked out once for each sample, not for each pair."""
    text = F.col(answer)
    each = samples.select(group, order, text.alias("answer"), word_set(text).alias("words"), *([(features(text) if features else text).alias("meant")] if semantic else []))
    listed = each.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*[c for c in each.columns if c != group]))).alias("s"))
    held = ["words", "meant"] if semantic else ["words"]
    side = lambda i, name: [F.get("s", i)[c].alias(f"{name}_{c}") for c in held]
    places = F.sequence(F.lit(0), F.size("s") - 1)
    pair = lambda i, j: F.struct(i.alias("left"), j.alias("right"), *side(i, "a"), *side(j, "b"))
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: pair(i, j))))
    found = listed.select(group, F.explode(pairs).alias("p")).select(group, "p.*")
    # each measure is a column before it is used again, so that it is worked out once for a pair
    measured = found.select(group, "left", "right", shared_words(F.col("a_words"), F.col("b_words")).alias("lexical"), *([semantic(F.col("a_meant"), F.col("b_meant")).alias("semantic")] if semantic else []))
    scored = measured.withColumn("semantic", clamp(F.col("semantic")) if semantic else F.col("lexical"))
    return scored.withColumn("combined", F.round(LEXICAL_WEIGHT * F.col("lexical") + SEMANTIC_WEIGHT * F.col("semantic"), 6)).withColumns({c: F.round(c, 6) for c in ("lexical", "semantic")})


def level(confidence: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(confidence >= threshold, "high").when(confidence >= max(0.0, threshold - MEDIUM_BELOW), "medium").otherwise("low")


def confidence(samples: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, group: str = "query_id", order: str = "sample", answer: str = "answer") -> DataFrame:
    """group, answer (the first sample), confidence, level, should_refuse, warning, lexical and semantic means; groups without pairs have 0."""
    firsts = samples.groupBy(group).agg(F.min_by(answer, order).alias("answer"), F.count("*").alias("n_samples"))
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    means = pairs.groupBy(group).agg(mean("combined").alias("confidence"), mean("lexical").alias("lexical_similarity"), mean("semantic").alias("semantic_similarity"))
    out = firsts.join(means, group, "left").fillna(0.0, ["confidence", "lexical_similarity", "semantic_similarity"])
    refusal = F.col("answer") == REFUSAL_ANSWER
    out = out.withColumn("level", level(F.col("confidence"), threshold)).withColumn("should_refuse", refusal | (F.col("confidence") < threshold))
    below = F.concat(F.lit("The sampled answers agree by "), fixed(F.col("confidence"), 2), F.lit(f" only; {threshold:.2f} is asked for."))
    warning = F.when(F.col("should_refuse"), F.when(refusal, "No answer could be grounded in the snippets that were found.").otherwise(below))
    return out.withColumn("warning", warning)


def apply_confidence(answers: DataFrame, judged: DataFrame, on: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Answers with their confidence; where it is too low, the refusal stands in for the answer, which is kept as candidate_answer."""
    joined = answers.join(judged.drop("answer"), list(on), "left")
    refuse = F.coalesce("should_refuse", F.lit(False))
    return joined.withColumn("candidate_answer", F.when(refuse, F.col("answer"))).withColumn("answer", F.when(refuse, REFUSAL_ANSWER).otherwise(F.col("answer")))


def sampled(asked: DataFrame, generator: Generator, temperatures: tuple[float, ...] = TEMPERATURES, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """query_id, sample, answer: one answer for each temperature."""
    out = None
    for i, t in enumerate(temperatures):
        one = generate(asked, generator, t).select("query_id", F.lit(i).alias("sample"), "answer")
        out = one if out is None else out.unionByName(one)
    return store(out)


def vector_similarity(a: Column, b: Column) -> Column:
    return clamp(cosine(a, b))
