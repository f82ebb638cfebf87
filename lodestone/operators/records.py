"""Records of other tools, whatever they call their fields: chunks, answers and their contexts, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, let
from .fusion import first_seen

#: Names under which records carry the same field, the first present counts.
CHUNK_NAMES = {
    "id": ("id", "chunk_id"),
    "filepath": ("filepath", "path", "file"),
    "function_name": ("function_name", "symbol_name", "name"),
    "start_line": ("start_line",),
    "end_line": ("end_line",),
    "docstring": ("docstring",),
    "source": ("source", "text", "document"),
    "language": ("language",),
}
ANSWER_NAMES = ("answer", "response")
CONTEXT_LISTS = ("retrieved_chunks", "retrieved_contexts", "contexts", "citations")

_FIELDS = ", ".join(f"{n} string" for names in CHUNK_NAMES.values() for n in names)
#: A chunk's record, alone or below `chunk`.
CHUNK_JSON = f"struct<{_FIELDS.replace(' string', ':string')}, chunk:struct<{_FIELDS.replace(' string', ':string')}>>".replace(", ", ",")
REFERENCES = "array<struct<filepath:string,function_name:string>>"


def chunk_fields(record: Column) -> Column:
    """The eight fields of a parsed chunk record: texts default to empty, numbers that are none to 0."""

    def of(c: Column) -> Column:
        out = []
        for field, names in CHUNK_NAMES.items():
            found = F.coalesce(*[c[n] for n in names])
            whole = F.coalesce(found.try_cast("int"), F.lit(0)) if field.endswith("_line") else F.coalesce(found, F.lit(""))
            out.append(whole.alias(field))
        return F.struct(*out)

    inner = record["chunk"]
    return F.when(inner.isNotNull(), of(inner)).otherwise(of(record))


def normalise_chunks(frame: DataFrame, payload: str = "payload") -> DataFrame:
    """The frame with `chunk`, the fields of its JSON records under any of their names (null: no JSON object)."""
    parsed = F.from_json(F.col(payload), CHUNK_JSON)
    is_object = F.trim(F.col(payload)).startswith("{")
    return frame.withColumn("chunk", F.when(is_object, let(parsed, chunk_fields)))


def location_key(chunk: Column) -> Column:
    """What makes two chunks the same: the id, or the place where there is none."""
    place = F.concat_ws(":", F.lit("loc"), chunk["filepath"], chunk["function_name"], chunk["start_line"].cast("string"), chunk["end_line"].cast("string"))
    return F.when(chunk["id"] != "", F.concat(F.lit("id:"), chunk["id"])).otherwise(place)


def first_chunks(rows: DataFrame, order: list[Column], group: tuple[str, ...] = ("query_id",), chunk: str = "chunk") -> DataFrame:
    """The first row of each chunk within a group, by id or place."""
    return first_seen(rows, location_key(F.col(chunk)), order, group)


def _said(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def normalise_outputs(frame: DataFrame, payload: str = "payload") -> DataFrame:
    """The frame with answer, contexts (filepath, function_name) and sources of a pipeline's output: a JSON
    object with any of the known names, or the bare answer."""
    contexts = ", ".join(f"{n}: array<{CHUNK_JSON}>" for n in CONTEXT_LISTS)
    parsed = F.from_json(F.col(payload), f"struct<{', '.join(f'{n}: string' for n in ANSWER_NAMES)}, {contexts}>")
    is_object = F.trim(F.col(payload)).startswith("{")
    held = frame.withColumn("__o", F.when(is_object, parsed))
    filled = [F.when(F.size(F.col(f"__o.{n}")) > 0, F.col(f"__o.{n}")) for n in CONTEXT_LISTS]
    listed = held.withColumn("__c", F.transform(F.coalesce(*filled, F.array().cast(f"array<{CHUNK_JSON}>")), lambda x: F.when(x["chunk"].isNotNull(), chunk_named(x["chunk"])).otherwise(chunk_named(x))))
    answer = F.when(F.col("__o").isNotNull(), F.coalesce(*[F.col(f"__o.{n}") for n in ANSWER_NAMES], F.lit(""))).otherwise(F.col(payload))
    places = F.filter("__c", lambda x: x["filepath"].isNotNull())
    return listed.withColumns({
        "answer": answer,
        "contexts": F.transform(places, lambda x: F.struct(x["filepath"].alias("filepath"), x["function_name"].alias("function_name"))),
        "sources": F.transform(F.filter("__c", lambda x: x["source"].isNotNull()), lambda x: x["source"]),
    }).drop("__o", "__c")


def chunk_named(c: Column) -> Column:
    """filepath, function_name and source under any of their names, null if empty."""
    return F.struct(*[_said(*[c[n] for n in CHUNK_NAMES[f]]).alias(f) for f in ("filepath", "function_name", "source")])


def place(context: Column, mark: str) -> Column:
    return F.concat_ws(mark, _said(context["filepath"]), F.when(_said(context["filepath"]).isNotNull(), _said(context["function_name"])))


def judge_contexts(contexts: Column) -> Column:
    """Contexts (filepath, function_name, source) as a judge reads them: place and source, or either; those without both fall away."""
    text = F.transform(contexts, lambda c: F.concat_ws("\n", F.nullif(place(c, "::"), F.lit("")), _said(c["source"])))
    return F.filter(text, lambda t: t != "")


def scorer_contexts(sources: Column, contexts: Column) -> Column:
    """What an outside scorer is given: the sources, or the places where there are none."""
    return F.when(F.size(sources) > 0, sources).otherwise(F.transform(contexts, lambda c: place(c, ":")))


def chunk_summary(chunks: Column) -> Column:
    """The five fields of each chunk that logs hold."""
    names = ("id", "filepath", "function_name", "start_line", "end_line")
    return F.transform(chunks, lambda c: F.struct(*[F.coalesce(c[n], F.lit(0 if n.endswith("line") else "")).alias(n) for n in names]))


def heading(chunks: Column, most: int = 5) -> tuple[Column, Column]:
    """The first chunks of a list, and how many more there are."""
    return F.slice(chunks, 1, most), F.greatest(F.size(chunks) - most, F.lit(0))


def short_text(text: Column, limit: int = 120) -> Column:
    """Text in one line, cut to the limit with three points."""
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.left(plain, F.lit(limit - 3)), F.lit("...")))


def metric_text(value: Column) -> Column:
    """A metric with three places, n/a where there is none."""
    number = value.try_cast("double")
    return F.when(value.isNull(), "n/a").when(number.isNull(), value.cast("string")).otherwise(fixed(number, 3))


def fixture_chunks(spark) -> DataFrame:
    """A few chunks to try things on."""
    rows = [
        ("fixture-shelf-add", "library/shelf.py", "Shelf.add", 8, 11, "Put a book on the shelf.", 'def add(self, book):\n    """Put a book on the shelf."""\n    self.books.append(book)\n    return self', "python"),
        ("fixture-shelf-module", "library/shelf.py", "__module__", 1, 3, "", "import json\n\nLIMIT = 40", "python"),
    ]
    return spark.createDataFrame(rows, "id string, filepath string, function_name string, start_line int, end_line int, docstring string, source string, language string")
