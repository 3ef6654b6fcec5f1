"""Watching a repository: change events, debounced by session windows, keyed by root.

Events of a root that follow each other within the gap form one batch; its end closes
when the watermark passes it.  Events later than the watermark are dropped by Spark and
counted in the query's progress.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repolytics.functions.predicates import LANGUAGES, extension
from repolytics.operators.code import IGNORED_DIRS

OPERATIONS = ("write", "create", "rename")


def relevant(events: DataFrame, marks: tuple[str, ...] | None = None) -> DataFrame:
    """Events (root, path, op, ts) that can change an analysis."""
    known = marks or tuple(m for v in LANGUAGES.values() for m in v.split())
    return events.filter(F.col("op").isin(*OPERATIONS) & extension("path").isin(*known))


def debounced(events: DataFrame, gap: str = "250 milliseconds", late: str = "10 seconds", key: str = "root", ts: str = "ts") -> DataFrame:
    """key, start, end, events: one row for each burst of events, in batch or stream."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    bursts = own.groupBy(F.col(key).alias("root"), F.session_window(F.col(ts), gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return bursts.select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def start(events: DataFrame, analyse, checkpoint: str, interval: str | None = None, gap: str = "250 milliseconds"):
    """Run analyse(bursts, batch_id) for every batch of closed bursts; exactly once a batch."""
    writer = debounced(events, gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(analyse)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def file_events(spark: SparkSession, root: str, at_once: int = 1000) -> DataFrame:
    """root, path, op, ts of files that appear below a folder, as a stream (new folders included)."""
    found = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", at_once).option("pathGlobFilter", "*.*").load(root)
    return found.select(F.lit(root).alias("root"), "path", F.lit("write").alias("op"), F.col("modificationTime").alias("ts"))


_MOVED = "root string, id bigint, score double, previous_score double, delta double"


def _against_last(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    out = []
    for frame in frames:
        for row in frame.sort_values("id").itertuples():
            out.append((key[0], row.id, row.score, last, None if last is None else row.score - last))
            last = row.score
    if out:
        state.update((last,))
    yield pd.DataFrame(out, columns=["root", "id", "score", "previous_score", "delta"]).astype({"previous_score": "float64", "delta": "float64"})


def movements(snapshots: DataFrame) -> DataFrame:
    """root, id, score, previous_score, delta of a stream of snapshots (root, id, score).

    The state of a root is its last score alone, so it stays as small as the number of roots.
    """
    return snapshots.select("root", "id", "score").groupBy("root").applyInPandasWithState(_against_last, _MOVED, "score double", "append", GroupStateTimeout.NoTimeout)


def polled(root: str, interval: float = 2.0) -> Iterator[list[str]]:
    """Lists of paths changed since the round before, every interval that has any; the first is empty."""
    seen: dict[str, float] = {}
    first = True
    while True:
        now: dict[str, float] = {}
        for folder, folders, names in os.walk(root):
            folders[:] = [d for d in folders if d not in IGNORED_DIRS]
            for name in names:
                path = os.path.join(folder, name)
                try:
                    now[os.path.relpath(path, root)] = os.stat(path).st_mtime
                except OSError:
                    continue  # it went meanwhile
        changed = sorted(p for p in now.keys() | seen.keys() if now.get(p) != seen.get(p))
        if first or changed:
            yield [] if first else changed
        seen, first = now, False
        time.sleep(interval)
