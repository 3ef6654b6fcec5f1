"""Bursts of change events with their paths, kept in a bounded buffer for each root.

The state of a root is a list of its latest events and how many older ones fell out of it.
Every event restarts the root's timer; when the watermark reaches it, events that follow
each other within the gap are one burst, bursts that are over are given out, and a root
without events left has no state.  Events come in any order within the watermark; later
ones are dropped by Spark before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "root string, start timestamp, `end` timestamp, events long, paths array<string>, dropped long"
MOST_EVENTS = 1_000


def split(events: list[tuple[int, str]], gap: int) -> list[list[tuple[int, str]]]:
    """Sorted events cut where one comes gap or more after the one before it."""
    found: list[list[tuple[int, str]]] = []
    for at, path in sorted(events):
        if found and at - found[-1][-1][0] < gap:
            found[-1].append((at, path))
        else:
            found.append([(at, path)])
    return found


class Buffered(StatefulProcessor):
    """gap in microseconds; most: events of a root that are kept at once, the newest."""

    def __init__(self, gap: int, most: int):
        self._gap, self._most = gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._events = handle.getListState("events", "us long, path string")
        self._dropped = handle.getValueState("dropped", "n long")
        self._timer = handle.getValueState("timer", "ms long")

    def _restart(self, last: int | None) -> None:
        """One timer a root: when the burst that ends with its last event is over."""
        if self._timer.exists():
            self._handle.deleteTimer(self._timer.get()[0])
            self._timer.clear()
        if last is not None:
            at = -(-(last + self._gap) // 1000)
            self._handle.registerTimer(at)
            self._timer.update((at,))

    def _over(self, key, events: list[tuple[int, str]], watermark: int) -> Iterator[Row]:
        """The bursts that end by the watermark (ms); the other events stay."""
        dropped = self._dropped.get()[0] if self._dropped.exists() else 0
        stay = []
        for burst in split(events, self._gap):
            end = burst[-1][0] + self._gap
            if end > watermark * 1000:
                stay += burst
                continue
            yield Row(root=key[0], start_us=burst[0][0], end_us=end, events=len(burst), paths=sorted({p for _, p in burst}), dropped=dropped)
            dropped = 0
        if stay:
            self._events.put([tuple(e) for e in stay])
            self._dropped.update((dropped,))
        else:
            self._events.clear()
            self._dropped.clear()
        self._restart(stay[-1][0] if stay else None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = [(e[0], e[1]) for e in self._events.get()] if self._events.exists() else []
        events += [(r["us"], r["path"]) for r in rows]
        events.sort()
        if len(events) > self._most:
            before = self._dropped.get()[0] if self._dropped.exists() else 0
            self._dropped.update((before + len(events) - self._most,))
            events = events[-self._most :]
        yield from self._over(key, events, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._timer.exists():
            self._timer.clear()  # it has fired
        yield from self._over(key, [(e[0], e[1]) for e in self._events.get()], max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def buffered(events: DataFrame, gap_ms: int = 250, late: str = "10 seconds", most: int = MOST_EVENTS) -> DataFrame:
    """root, start, end, events, paths, dropped: one row for each burst of a stream (root, path, ts).

    dropped: older events of the root that the buffer no longer held when the burst ended.
    The session needs the RocksDB state store (STATE_STORE).
    """
    own = events.select("root", "path", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    raw = "root string, start_us long, end_us long, events long, paths array<string>, dropped long"
    found = own.groupBy("root").transformWithState(Buffered(gap_ms * 1000, most), raw, "Append", "EventTime")
    return found.select("root", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "events", "paths", "dropped")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bursts(events: DataFrame, gap: str = "250 milliseconds", key: str = "root", ts: str = "ts", path: str = "path") -> DataFrame:
    """root, start, end, events, paths of a table of events: the same bursts without a buffer."""
    grouped = events.groupBy(F.col(key).alias("root"), F.session_window(F.col(ts), gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_set(path)).alias("paths")).select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "paths")
