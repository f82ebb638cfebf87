import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lodestone.operators import dense
from lodestone.plans import catalog, records_catalog  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def database(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows_of(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, data, database, name):
    found = catalog.QUERIES[name](spark, data)
    rows = found.collect()
    if name in catalog.ORACLE_SQL:
        cursor = database.execute(catalog.ORACLE_SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(found.columns)
        assert rows_of(cursor.fetchall()) == rows_of([tuple(r[n] for n in names) for r in rows])
    else:
        assert rows


def test_label_precision_is_given_for_every_row(spark, tmp_path):
    r = np.random.default_rng(4)
    vectors, labels = dense.units(r.normal(size=(90, 6))).astype(np.float32), r.integers(0, 3, 90)
    rows = [(i, v, label) for i, (v, label) in enumerate(zip(vectors.tolist(), labels.tolist(), strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {x.query_id: (x.precision_at_10, x.hit) for x in catalog.QUERIES["knn_label_precision"](spark, str(tmp_path)).collect()}
    unit = dense.units(vectors.astype(float))
    hits = labels[np.argsort(-(unit @ unit.T), axis=1)[:, 1:11]] == labels[:, None]
    assert found == {i: (round(h.mean(), 6), float(h.any())) for i, h in enumerate(hits)}


def test_library_stands_without_the_training_data_operators():
    code = "import sys; sys.modules['lodestone.llm'] = None\nimport pkgutil, importlib, lodestone\n[importlib.import_module(m.name) for m in pkgutil.walk_packages(lodestone.__path__, 'lodestone.') if '.llm' not in m.name]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    assert not [p for p in (ROOT / "lodestone").rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]


@pytest.mark.parametrize("kept", [["corpus_pipeline.py"], []])
def test_entry_stands_without_the_training_data_folders(tmp_path, kept):
    import shutil

    for name in ["__spark_entry__.py", *kept]:
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
