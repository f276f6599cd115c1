"""Copying of files that changed, by Spark tasks, between folders that all executors see."""

import glob
import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def changed(source: str, target: str) -> bool:
    """Whether the target is missing, of another size, or older."""
    if not os.path.exists(target):
        return True
    a, b = os.stat(source), os.stat(target)
    return a.st_size != b.st_size or a.st_mtime_ns > b.st_mtime_ns


def sync_files(spark: SparkSession, pattern: str, folder: str, per_task: int = 256) -> DataFrame:
    """path and copied of every file of ``pattern``. A file is written beside its target and moved there, so a task that is
    lost or runs twice leaves no half file. The copying happens when the result is computed."""
    found = sorted(p for p in glob.glob(pattern, recursive=True) if os.path.isfile(p))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            done = []
            for path in b["path"].to_pylist():
                target = os.path.join(folder, os.path.basename(path))
                fresh = changed(path, target)
                if fresh:
                    part = f"{target}.{os.getpid()}.part"
                    shutil.copy2(path, part)
                    os.replace(part, target)
                done.append(fresh)
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(done, pa.bool_())], names=["path", "copied"])

    paths = spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, -(-len(found) // per_task)))
    return paths.mapInArrow(copy, "path string, copied boolean")
