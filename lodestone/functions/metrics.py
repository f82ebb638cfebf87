"""Answer and retrieval metrics as Column expressions (the subsequence metric: an Arrow UDF)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, word_tokens


def _pair(a: Column, b: Column) -> Column:
    return F.struct(word_tokens(a).alias("a"), word_tokens(b).alias("b"))


def _f1(common: Column, a: Column, b: Column) -> Column:
    return F.when((common > 0) & (a > 0) & (b > 0), 2.0 * common / (a + b)).otherwise(0.0)


def token_overlap(answer: Column, truth: Column) -> Column:
    """Share of the truth's distinct tokens that the answer has; an empty truth gives 0."""

    def share(s: Column) -> Column:
        wanted = F.array_distinct(s["b"])
        return F.when(F.size(wanted) > 0, F.size(F.array_intersect(F.array_distinct(s["a"]), wanted)) / F.size(wanted)).otherwise(0.0)

    return let(_pair(answer, truth), share)


def _clipped(s: Column) -> Column:
    """Common tokens, each counted as often as both have it: runs of equal tokens in the sorted lists."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(s["a"], s["b"]), F.lit(0), lambda n, x: n + F.least(count(s["a"], x), count(s["b"], x)))


def rouge1(answer: Column, truth: Column) -> Column:
    """F1 of the common tokens."""
    return let(_pair(answer, truth), lambda s: _f1(_clipped(s), F.size(s["a"]), F.size(s["b"])))


def bleu1(answer: Column, truth: Column) -> Column:
    """Share of the answer's tokens that the truth has, with a penalty for short answers."""

    def score(s: Column) -> Column:
        n, m = F.size(s["a"]), F.size(s["b"])
        penalty = F.when(n > m, F.lit(1.0)).otherwise(F.exp(1.0 - m / F.greatest(n, F.lit(1))))
        return F.when((n > 0) & (m > 0), _clipped(s) / F.greatest(n, F.lit(1)) * penalty).otherwise(0.0)

    return let(_pair(answer, truth), score)


def subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: a word's places in `a` are bits."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _subsequences(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([subsequence(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(answer: Column, truth: Column) -> Column:
    """F1 of the longest common subsequence."""
    longest = F.pandas_udf(_subsequences, "int")
    a, b = word_tokens(answer), word_tokens(truth)
    return _f1(longest(a, b), F.size(a), F.size(b))


def same_context(expected: Column, actual: Column) -> Column:
    """Same file, and same function where one is expected."""
    return (expected["filepath"] == actual["filepath"]) & (expected["function_name"].isNull() | (expected["function_name"] == actual["function_name"]))


def matched(expected: Column, actual: Column) -> Column:
    """Expected contexts that were retrieved."""
    return F.filter(expected, lambda e: F.exists(actual, lambda a: F.coalesce(same_context(e, a), F.lit(False))))


def missing(expected: Column, actual: Column) -> Column:
    return F.filter(expected, lambda e: ~F.exists(actual, lambda a: F.coalesce(same_context(e, a), F.lit(False))))


def context_hit(expected: Column, actual: Column) -> Column:
    return (F.size(matched(expected, actual)) > 0).cast("double")


def context_recall(expected: Column, actual: Column) -> Column:
    return F.when(F.size(expected) > 0, F.size(matched(expected, actual)) / F.size(expected)).otherwise(0.0)


def context_precision(expected: Column, actual: Column) -> Column:
    hits = F.filter(actual, lambda a: F.exists(expected, lambda e: F.coalesce(same_context(e, a), F.lit(False))))
    return F.when(F.size(actual) > 0, F.size(hits) / F.size(actual)).otherwise(0.0)
