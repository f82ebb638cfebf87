import numpy as np
import pytest

from lodestone.llm import common

from .conftest import SCHEMA, prose


def test_sizes_of_frames_without_files(spark):
    rows = [(i, prose(i, 100), "en", "a", 1) for i in range(50)]
    whole = sum(len(t) + 4 + 24 for _, t, *_ in rows)
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, 7), SCHEMA)
    assert 0.8 * whole < common.input_bytes(frame) < 1.3 * whole
    assert common.parts_for(frame, 1000, 2) == -(-common.input_bytes(frame) // 1000)
    assert common.input_bytes(frame.limit(0)) >= 0


def test_only_frames_of_files_are_replayed(spark, tmp_path):
    rows = [(i, prose(i, 20), "en", "a", 1) for i in range(50)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert common.replayable(docs) is docs
    plain = docs.filter("doc_id > 3").select("doc_id", "text")
    assert common.replayable(plain) is plain
    for other in (docs.repartition(3), docs.dropDuplicates(["text"]), docs.selectExpr("*", "rand() AS r").filter("r > 0.1")):
        stored = common.replayable(other)
        assert stored is not other and sorted(stored.collect()) == sorted(stored.collect())


def test_packed_arrays_come_back():
    r = np.random.default_rng(1)
    arrays = [r.integers(0, 2**64, 100, dtype=np.uint64), np.arange(300), np.array([-1, 5]), np.zeros(0, np.int64), np.linspace(0, 1, 7).astype("<f4")]
    for a, b in zip(arrays, common.unpack(common.pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)


def test_folder_of_the_session(spark):
    folder = common.shared_folder(spark)
    assert "://" in folder
    with pytest.raises(RuntimeError):
        from lodestone.session import checkpoint_folder

        class Far:
            master = "spark://host:7077"

            def getCheckpointDir(self):  # noqa: N802
                return None

        class Session:
            sparkContext = Far()  # noqa: N815

            class conf:  # noqa: N801
                get = staticmethod(lambda key, default: default)

        checkpoint_folder(Session())
