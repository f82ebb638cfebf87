import os
from pathlib import Path

import pytest

from lodestone.sources import repository


@pytest.fixture()
def tree(tmp_path):
    for name in ("b.py", "a/z.py", "a/b/c/deep.py", "a-1/x.py", "build/out.py", "node_modules/m/y.js", "src/build/n.py", ".git/config", "_hidden.py", "src/with space/é.py", "src/__init__.py"):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "tree/empty").mkdir()
    os.symlink(tmp_path / "tree", tmp_path / "tree/a/loop")
    return str(tmp_path / "tree")


def walked(root: str, ignored=repository.IGNORED_DIRS) -> list[str]:
    """All files by a walk on this machine, in the order of their paths."""
    found = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n not in ignored]
        found += [Path(folder, f).relative_to(root).as_posix() for f in files]
    return sorted(found, key=lambda p: p.split("/"))


@pytest.mark.parametrize("form", ["{}", "file://{}", "{}/"])
def test_levels_give_what_a_walk_gives(spark, tree, form):
    from pyspark.sql import functions as F

    root = form.format(tree)
    files = repository.read_repository(spark, root).orderBy(F.split("filepath", "/")).collect()
    assert [r.filepath for r in files] == walked(tree)
    assert all(bytes(r.content).decode() == r.filepath for r in files)
    every = {r.filepath for r in repository.list_files(spark, root, all_folders=True).collect()}
    assert every == set(walked(tree, ())) and ".git/config" in every


def test_many_folders_go_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repository, "FOLDERS_EACH", 8)
    monkeypatch.setattr(repository, "FILES_EACH", 10)
    for i in range(40):
        (tmp_path / f"d{i}/e").mkdir(parents=True)
        (tmp_path / f"d{i}/e/f.txt").write_bytes(bytes([i]) * 3)
    files = repository.read_repository(spark, str(tmp_path))
    assert {(r.filepath, bytes(r.content)) for r in files.collect()} == {(f"d{i}/e/f.txt", bytes([i]) * 3) for i in range(40)}
    assert files.rdd.getNumPartitions() == 4
    monkeypatch.setattr(repository, "BATCH_BYTES", 4)
    assert repository.read_repository(spark, str(tmp_path)).count() == 40


def test_roots_that_are_no_folders(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(FileNotFoundError):
        repository.read_repository(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        repository.read_repository(spark, str(tmp_path / "file"))
    (tmp_path / "void").mkdir()
    assert repository.read_repository(spark, str(tmp_path / "void")).collect() == []
