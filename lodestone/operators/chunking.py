"""Corpus files to chunks: symbols of Python files, sections of readmes, line windows, path filters."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id
from .recovery import definitions

#: File kinds and folders.
LICENSE_NAMES = "copying copying.md copying.txt license license.md license.txt notice notice.md notice.txt".split()
SOURCE_SUFFIXES = ".py .js .ts .java".split()
README_LANGUAGES = {"": "text", ".md": "markdown", ".rst": "rst", ".txt": "text"}
GENERATED_SUFFIXES = ".min.js _pb2.py _pb2_grpc.py".split()
GENERATED_MARKERS = ["@generated", "auto-generated", "autogenerated", "do not edit", "generated by"]
CHUNK_IGNORED_DIRS = ".git .hg .mypy_cache .pytest_cache .ruff_cache .tox .venv __pycache__ build dist node_modules site-packages".split()
MODULE_NAME = "__module__"

#: Characters of chunks that are put out together, and what a chunk counts for besides its text.
AT_ONCE, ROW_CHARS = 1 << 20, 200

SYMBOLS = "array<struct<name:string,id_name:string,start_line:int,end_line:int,docstring:string,source:string>>"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]*)$", 1))


def is_readme(path: Column) -> Column:
    """README with one of four suffixes, in any case."""
    return F.lower(file_name(path)).rlike(r"^readme(\.md|\.rst|\.txt)?$")


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end begins no line, an empty text has none."""
    cut = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.when(text == "", F.array().cast("array<string>")).when(F.get(cut, F.size(cut) - 1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def is_text(content: Column) -> Column:
    """UTF-8 without NUL bytes."""
    return (F.position(F.lit(b"\x00"), content) == 0) & F.is_valid_utf8(content.cast("string"))


def skip_reason(path: Column, text: Column, max_lines: int = 500) -> Column:
    """Why a file is left out (null: kept); the first reason counts.  A null text is binary."""
    name, lines = F.lower(file_name(path)), lines_of(text)
    head = F.lower(F.array_join(F.slice(lines, 1, 20), "\n"))
    generated = reduce(lambda a, b: a | b, [name.endswith(s) for s in GENERATED_SUFFIXES] + [head.contains(m) for m in GENERATED_MARKERS])
    return (
        F.when(name.isin(LICENSE_NAMES), "license")
        .when(~(is_readme(path) | suffix(path).isin(SOURCE_SUFFIXES)), "unsupported_type")
        .when(text.isNull(), "binary_or_non_utf8")
        .when(generated, "generated")
        .when(F.size(lines) > max_lines, F.concat(F.lit("too_many_lines:"), F.size(lines).cast("string")))
    )


def ingest(files: DataFrame, max_lines: int = 500) -> DataFrame:
    """filepath, raw_content, skip_reason of repository files (filepath, content)."""
    text = F.when(is_text(F.col("content")), F.decode("content", "UTF-8"))
    return files.select("filepath", text.alias("raw_content")).withColumn("skip_reason", skip_reason(F.col("filepath"), F.col("raw_content"), max_lines))


def skip_counts(ingested: DataFrame) -> DataFrame:
    return ingested.filter("skip_reason IS NOT NULL").groupBy(F.regexp_extract("skip_reason", "^[^:]*", 0).alias("reason")).agg(F.count("*").alias("files")).orderBy("reason")


def python_symbols(source: str) -> list[tuple[str, str, int, int, str, str]]:
    """name, name for the id, first and last line, docstring and text of a file's module parts and definitions; of a file that
    doesn't parse, the definitions around what is broken, without docstrings."""
    lines = source.splitlines()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(name, name, start, end, "", "\n".join(lines[start - 1 : end])) for name, start, end in definitions(source)]
    found: list[tuple[str, str, int, int, str, str]] = []

    def add(name: str, start: int, end: int, doc: str) -> None:
        found.append((name, name, start, end, doc, "\n".join(lines[start - 1 : end])))

    plain = [n for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.TypeAlias))]
    spans: list[list[int]] = []
    for node in plain:
        gap = lines[spans[-1][1] : node.lineno - 1] if spans else None
        if gap is not None and all(not x.strip() or x.strip().startswith("#") for x in gap):
            spans[-1][1] = max(spans[-1][1], node.end_lineno)
        else:
            spans.append([node.lineno, node.end_lineno])
    for i, (start, end) in enumerate(spans, 1):
        add(MODULE_NAME if i == 1 else f"{MODULE_NAME}:{i}", start, end, ast.get_docstring(tree) or "" if i == 1 else "")

    def visit(node: ast.AST, scope: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = (*scope, child.name)
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                add(".".join(inner), start, child.end_lineno, ast.get_docstring(child) or "")
            visit(child, inner)

    visit(tree, ())
    return found


def readme_sections(text: str) -> list[tuple[str, str, int, int, str, str]]:
    """Sections of a readme: from each heading to the next; before the first, each paragraph."""
    lines = text.splitlines()
    windows: list[list] = []  # title, first, last line
    headed = False
    for number, line in enumerate(lines, 1):
        heading = re.match(r"#{1,6}\s+(.+)", line.strip())
        if heading:
            headed = True
            windows.append([heading[1].strip(), number, number])
        elif headed:
            windows[-1][2] = number
        elif line.strip():
            if windows and windows[-1][2] == number - 1:
                windows[-1][2] = number
            else:
                windows.append([line.strip()[:80], number, number])
    out, part = [], 0
    for title, start, end in windows:
        body = "\n".join(lines[start - 1 : end]).strip()
        if not body:
            continue
        part += 1
        short = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")[:60]
        name = f"README:{short or f'part-{part}'}"
        out.append((name, name, start, end, title, body))
    return out


def _chunks_of_files(batches: Iterator) -> Iterator:
    """Chunks of files, put out whenever those found come to `AT_ONCE` characters: a batch's files can be of any size."""
    import pyarrow as pa

    kinds = [("filepath", pa.string()), ("function_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("docstring", pa.string()), ("source", pa.string()), ("language", pa.string())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    for files in batches:
        rows, held = [], 0
        for at in range(files.num_rows):
            path, text = files.column(0)[at].as_py(), files.column(1)[at].as_py()
            if path.endswith(".py"):
                found, language = python_symbols(text), "python"
            else:
                extension = re.search(r"(\.[^./]*)?$", path.lower())[0]
                found, language = readme_sections(text), README_LANGUAGES.get(extension, "text")
            for name, _, start, end, doc, body in found:
                rows.append((path, name, start, end, doc, body, language))
                held += len(body) + ROW_CHARS
                if held >= AT_ONCE:
                    yield batch(rows)
                    rows, held = [], 0
        yield batch(rows)


def chunk_files(files: DataFrame, max_chunk_lines: int | None = None, overlap: int = 20) -> DataFrame:
    """Chunks of text files (filepath, raw_content): Python and README files outside ignored folders."""
    parts = F.split("filepath", "/")
    inside = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, CHUNK_IGNORED_DIRS)))
    readme = F.col("filepath").rlike(r"(^|/)README(\.md|\.rst|\.txt)?$")
    wanted = files.filter(F.col("raw_content").isNotNull() & ~inside & (F.col("filepath").endswith(".py") | readme)).select("filepath", "raw_content")
    found = wanted.mapInArrow(_chunks_of_files, "filepath string, function_name string, start_line int, end_line int, docstring string, source string, language string")
    found = found.withColumn("id", chunk_id(F.col("filepath"), F.col("function_name"), F.col("start_line"), F.col("end_line")))
    if max_chunk_lines is not None:
        found = split_oversized(found, max_chunk_lines, overlap)
    return found.select("id", "filepath", "function_name", "start_line", "end_line", "docstring", "source", "language")


def corpus_order() -> list[Column]:
    return [F.asc(c) for c in ("filepath", "start_line", "end_line", "function_name")]


def check_window(max_lines: int, overlap: int) -> None:
    if max_lines < 1:
        raise ValueError("max_chunk_lines must be positive")
    if overlap < 0:
        raise ValueError("chunk_overlap_lines must not be negative")
    if overlap >= max_lines:
        raise ValueError("chunk_overlap_lines must be smaller than max_chunk_lines")


def line_windows(count: Column, max_lines: int, overlap: int) -> Column:
    """Windows over `count` lines as structs of first and one-past-last line, from 0."""
    check_window(max_lines, overlap)
    step = max_lines - overlap
    n = F.greatest(F.lit(1), F.ceil((count - overlap) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).alias("begin"), F.least(i * step + max_lines, count).alias("end")))


def split_oversized(chunks: DataFrame, max_lines: int, overlap: int = 20) -> DataFrame:
    """Chunks of more than `max_lines` lines as overlapping windows; the parts' ids name the part."""
    lines = lines_of(F.col("source"))
    cut = chunks.withColumn("__lines", lines).withColumn("__windows", line_windows(F.size("__lines"), max_lines, overlap))
    parts = cut.select("*", F.posexplode("__windows").alias("__part", "__w"))
    many = F.size("__windows") > 1
    start = F.col("start_line") + F.col("__w.begin")
    end = F.col("start_line") + F.col("__w.end") - 1
    label = F.concat("function_name", F.lit(":part:"), (F.col("__part") + 1).cast("string"), F.lit("/"), F.size("__windows").cast("string"))
    return parts.select(
        F.when(many, chunk_id(F.col("filepath"), label, start, end)).otherwise(F.col("id")).alias("id"),
        "filepath",
        "function_name",
        F.when(many, start).otherwise(F.col("start_line")).cast("int").alias("start_line"),
        F.when(many, end).otherwise(F.col("end_line")).cast("int").alias("end_line"),
        "docstring",
        F.when(many, F.array_join(F.slice("__lines", F.col("__w.begin") + 1, F.col("__w.end") - F.col("__w.begin")), "\n")).otherwise(F.col("source")).alias("source"),
        "language",
    )


def under_prefix(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; an empty prefix holds all."""
    clean = prefix.strip().strip("/").removeprefix("./")
    return F.lit(True) if clean in ("", ".") else (path == clean) | path.startswith(clean + "/")


def is_test_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return file_name(path).startswith("test_") | F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests")))


def filter_paths(chunks: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), exclude_tests: bool = False, path: str = "filepath") -> DataFrame:
    """Rows under any included prefix and no excluded one."""
    column = F.col(path)
    if include:
        chunks = chunks.filter(reduce(lambda a, b: a | b, [under_prefix(column, p) for p in include]))
    if exclude:
        chunks = chunks.filter(~reduce(lambda a, b: a | b, [under_prefix(column, p) for p in exclude]))
    return chunks.filter(~is_test_path(column)) if exclude_tests else chunks


def paragraph_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, section, first and last line, n_lines of the paragraphs between blank lines, in DataFrame functions."""
    from pyspark.sql import Window

    lines = docs.select(F.col(key), F.posexplode(lines_of(F.col(text))).alias("pos", "line")).withColumn("blank", F.trim("line") == "")
    order = Window.partitionBy(key).orderBy("pos")
    opens = ~F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(True))
    numbered = lines.withColumn("opens", opens.cast("int")).withColumn("section", F.sum("opens").over(order)).filter("NOT blank")
    return numbered.groupBy(key, "section").agg((F.min("pos") + 1).alias("first_line"), (F.max("pos") + 1).alias("last_line"), F.count("*").alias("n_lines"))
