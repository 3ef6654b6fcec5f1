"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words of a text: runs of anything but space and \\x09-\\x0D."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is the session's spark.checkpoint.dir; where that is unset (local tests) a
    temporary folder of this machine becomes it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_repolytics_shared", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="repolytics-")
            spark.sparkContext._repolytics_shared = folder
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not created) below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, an action's shuffle files go once its result is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, actions hand Python at most so many rows at once, which bounds what long texts take in both processes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting when it is made


class Tables:
    """Tables of a job in the shared folder: each cuts the lineage, and goes when nothing reads it any more, not when the driver happens to collect its garbage."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._name, self._folders = spark, name, {}

    def put(self, df: DataFrame, slot: str) -> DataFrame:
        """Write df and read it back; what the slot held before goes."""
        folder, before = new_folder(self._spark, self._name), self._folders.get(slot)
        with shuffles_removed(self._spark):
            df.select("*").write.parquet(folder)  # a frame takes the setting when it is made
        self._folders[slot] = folder
        if before:
            removed_folder(self._spark, before)
        return self._spark.read.parquet(folder)

    def drop(self, *slots: str) -> None:
        for slot in slots:
            removed_folder(self._spark, self._folders.pop(slot))

    def done(self) -> None:
        self.drop(*self._folders)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; of a file scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized_partitions(df: DataFrame, bytes_each: int, least: int = 12, most: int = 200_000) -> int:
    """How many partitions of about bytes_each the frame's input makes.

    Where Catalyst knows no size (rows made in Python) the session's shuffle partitions.
    """
    size = plan_bytes(df)
    if size >= 1 << 60:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return int(min(most, max(least, size // bytes_each)))


MOST_HEAVY = 1_000


def heavy_join(rows: DataFrame, known: DataFrame, key: str | tuple[str, str], weight: str, value: str, most_heavy: int = MOST_HEAVY) -> DataFrame:
    """rows with value, inner joined with known (key once each, weight = its rows, value).

    Keys that hold more than the most_heavy-th part of all weight number fewer than
    most_heavy, whatever the input, so they are broadcast and their rows stay where they
    are; only rows of lighter keys are shuffled, a key at most a small part of a task's.
    known should be cut off from its lineage, as it is read three times.
    """
    own, other = (key, key) if isinstance(key, str) else key
    total = known.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("double").alias("t")).first()["t"]
    is_heavy = F.col(weight).cast("double") * most_heavy > total
    heavy = known.filter(is_heavy).select(F.col(other).alias("heavy_key"), F.col(value).alias("heavy_value"))
    light = known.filter(~is_heavy).select(F.col(other).alias("light_key"), F.col(value).alias("light_value"))
    marked = rows.join(F.broadcast(heavy), F.col(own) == F.col("heavy_key"), "left")
    found = marked.filter("heavy_key is not null").select(*rows.columns, F.col("heavy_value").alias(value))
    rest = marked.filter("heavy_key is null").select(*rows.columns).join(light, F.col(own) == F.col("light_key"))
    return found.unionByName(rest.select(*rows.columns, F.col("light_value").alias(value)))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of an Arrow batch as Python tuples, a slice at a time."""
    for at in range(0, batch.num_rows, 512):
        part = batch.slice(at, 512)
        yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def held_out(doc_id, fold: int = 1):
    """Whether a row belongs to the held-out fold: crc32 of its id as text, mod 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == fold, F.lit(False))


def local_path(uri: str) -> str:
    return uri[len("file://") :] if uri.startswith("file://") else uri[len("file:") :] if uri.startswith("file:") else uri


def is_local(uri: str) -> bool:
    return uri.startswith(("file:", "/")) or os.path.isabs(uri)


_KEPT: dict[str, object] = {}


def worker_object(key: str, make):
    """What make() gives, kept by this Python worker for its next tasks; one object at most."""
    if key not in _KEPT:
        _KEPT.clear()
        release_memory()
        _KEPT[key] = make()
    return _KEPT[key]


def release_memory() -> None:
    """Give freed memory back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
