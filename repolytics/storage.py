"""Where intermediate tables go that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: spark.checkpoint.dir.

    Where that is unset a local session takes a temporary folder of this machine; on a
    cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_repolytics_storage", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.sparkContext._repolytics_storage = "file://" + tempfile.mkdtemp(prefix="repolytics-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever it is stored; nothing happens where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def published(spark: SparkSession, local: str, name: str) -> str:
    """A copy, below the shared folder, of a file that the driver wrote for itself."""
    folder = new_folder(spark, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    target = f"{folder}/{local.rpartition('/')[2]}"
    store.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), spark._jvm.org.apache.hadoop.fs.Path(target))
    return target


class Rounds:
    """Tables of an iteration: each cuts the lineage, and goes once the next one is written."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._name, self._kept = spark, name, {}

    def put(self, df: DataFrame, slot: str) -> DataFrame:
        """Write df and read it back; what the slot held before is deleted."""
        folder, before = new_folder(self._spark, self._name), self._kept.get(slot)
        df.write.parquet(folder)
        self._kept[slot] = folder
        if before:
            remove(self._spark, before)
        return self._spark.read.parquet(folder)

    def done(self, df: DataFrame) -> DataFrame:
        """A checkpoint of the result; all tables of the iteration are deleted."""
        shared_folder(self._spark)
        result = df.checkpoint(eager=True)
        for folder in self._kept.values():
            remove(self._spark, folder)
        self._kept = {}
        return result
