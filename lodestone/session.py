"""What every query needs of its session."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let local Python workers import this package; a cluster has it installed or gets it by --py-files."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all machines share, spark.checkpoint.dir.  Only a session on one machine gets a
    temporary one where none is set; on a cluster its executors could not read that."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(frame: DataFrame) -> DataFrame:
    """The frame as files in the shared folder: what made it, a model say, isn't called again, whoever reads it or is lost."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
