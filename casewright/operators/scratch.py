"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing Parquet below ``spark.checkpoint.dir`` and reading it
back: a lost executor then costs a re-read, not a re-run, and the optimizer sees real sizes.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a purely local session gets one of its own if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="casewright-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """A family of temporary tables under one unique shared folder.

    Results may still read them after the operator has returned, so the folder goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        files, root = self._at(self.root)
        files.mkdirs(root)
        files.deleteOnExit(root)

    def _at(self, path: str):
        """The file system of a path, and the path for it."""
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(context._jsc.hadoopConfiguration()), found

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def keep(self, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` and return it as read back; ``drop`` releases it."""
        path = self.path(label)
        df.write.option("compression", compression).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._casewright_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            files, path = self._at(df._casewright_path)
            files.delete(path, True)

    def sweep(self) -> None:
        """Let Spark's cleaner delete shuffle files that no live DataFrame refers to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
