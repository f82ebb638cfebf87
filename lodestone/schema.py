"""Record types of the engine as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CHUNK = _struct(id=_S, filepath=_S, function_name=_S, start_line=_I, end_line=_I, docstring=_S, source=_S, language=_S)
RAW_FILE = _struct(filepath=_S, raw_content=_S)
SKIPPED_FILE = _struct(filepath=_S, reason=_S)
REPO_FILE = _struct(filepath=_S, content=T.BinaryType())
CONTEXT_REF = _struct(filepath=_S, function_name=_S)
EVAL_ITEM = _struct(id=_S, question=_S, ground_truth_answer=_S, ground_truth_context=T.ArrayType(CONTEXT_REF), expected_refusal=_B)
SYMBOL = _struct(name=_S, start_line=_I, end_line=_I, docstring=_S, source=_S)
PAIR_SCORE = _struct(left=_I, right=_I, lexical=_D, semantic=_D, combined=_D)
JUDGE_SCORES = _struct(answer_correctness=_D, faithfulness=_D, refusal_quality=_D, error=_S)
