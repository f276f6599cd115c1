"""Cutting lineage at tables that are read more than once."""

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees to it that the session has a folder for checkpoints: the shared one of spark.checkpoint.dir. Only a
    session in one process (master ``local``), as in tests, gets a temporary one where none is set; on a cluster,
    whose executors could not share it, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tapeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
