"""Source of the files of repositories, and of evaluation sets."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVAL_ITEM
from ..session import importable, stored

#: Folders that are never entered.
IGNORED_DIRS = frozenset(
    ".git .hg .mypy_cache .pytest_cache .ruff_cache .tox .venv __pycache__ build coverage dist env migrations node_modules site-packages venv".split()
)


#: Folders that a task lists, files that a task reads, bytes of content that it hands on at once.
FOLDERS_EACH, FILES_EACH, BATCH_BYTES = 64, 256, 32 << 20


def opened(root: str):
    """The file system of a path or URI, and the root's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))


def list_files(spark: SparkSession, root: str, all_folders: bool = False) -> DataFrame:
    """filepath (relative, with slashes) of every file below a folder, listed level by level: tasks list the folders of a level, and
    those that they find, but for ignored ones and links, are the next.  The driver only counts them."""
    importable(spark)

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = opened(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                names, kinds = [], []
                for info in system.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top)):
                    entered = info.type == fs.FileType.Directory and (all_folders or info.base_name not in IGNORED_DIRS) and not (local and os.path.islink(info.path))
                    if entered or info.type == fs.FileType.File:
                        names.append(f"{folder}/{info.base_name}" if folder else info.base_name)
                        kinds.append(entered)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.bool_())], ["filepath", "is_folder"])

    level, found = spark.createDataFrame([("",)], "folder string"), []
    while True:
        level = stored(level.mapInArrow(children, "filepath string, is_folder boolean"))
        found.append(level.filter(~F.col("is_folder")).select("filepath"))
        folders = level.filter("is_folder").select(F.col("filepath").alias("folder"))
        count = folders.count()
        if not count:
            return reduce(lambda a, b: a.unionByName(b), found)
        level = folders.repartition(-(-count // FOLDERS_EACH), "folder")


def read_repository(spark: SparkSession, root: str, all_folders: bool = False) -> DataFrame:
    """filepath and content of every file below a folder of any file system that tasks can open (a local path: one that all machines see)."""
    from pyarrow import fs

    system, top = opened(root)
    kind = system.get_file_info(top).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if kind != fs.FileType.Directory:
        raise NotADirectoryError(root)
    files = list_files(spark, root, all_folders)
    count = files.count()

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            paths, held, size = [], [], 0
            for path in batch.column(0).to_pylist():
                with system.open_input_file(f"{top}/{path}") as data:
                    held.append(data.read())
                paths.append(path)
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["filepath", "content"])
                    paths, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["filepath", "content"])

    return files.repartition(max(1, -(-count // FILES_EACH)), "filepath").mapInArrow(contents, "filepath string, content binary")


def clone(url: str, destination: str) -> str:
    """Clone a repository with git, or use the clone that is there."""
    target = Path(destination)
    if (target / ".git").exists():
        return str(target)
    if target.exists() and any(target.iterdir()):
        raise FileExistsError(f"{destination} holds something else")
    subprocess.run(["git", "clone", "--depth", "1", "--", url, str(target)], check=True, capture_output=True)
    return str(target)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items of a JSON list; bad items raise a ValueError."""
    items = spark.read.schema(EVAL_ITEM).option("multiLine", True).option("mode", "FAILFAST").json(path)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad_refs = F.exists("ground_truth_context", lambda x: F.coalesce(x["filepath"], F.lit("")) == "")
    bad = blank("id") | blank("question") | blank("ground_truth_answer") | F.col("ground_truth_context").isNull() | bad_refs
    found = items.agg(F.count_if(bad).alias("bad"), (F.count("id") - F.count_distinct("id")).alias("repeated")).first()
    if found.bad or found.repeated:
        raise ValueError(f"{found.bad} items lack a field, {found.repeated} repeat an id")
    return items.withColumn("expected_refusal", F.coalesce("expected_refusal", F.lit(False)))
