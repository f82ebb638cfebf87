import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows and keys."""
    long = prose(1, 30_000)
    base = prose(2, 300)
    near = base.split()
    near[50] = "changed"
    texts = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n "), (6, "word"), (7, "two words"),
        (8, long), (9, prose(3, 60) + " " + base[:500]), (10, "É é ß 漢字 🙂\x0b\x0c end"), (11, prose(4, 400)), (11, prose(4, 400)), (11, prose(5, 80)), (None, prose(6, 80)), (None, None),
    ]
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts]
    return [*rows, (12, prose(7, 90), None, None, None)]


@pytest.fixture()
def edges(spark):
    """Edge rows, and extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    clash = {c: F.lit(1) for c in ("ids", "key", "node", "did", "root", "size", "shard", "kept", "n_tokens", "hash", "host", "block", "component", "id", "n_words", "base_failed", "begin")}
    return docs.withColumns(clash)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
