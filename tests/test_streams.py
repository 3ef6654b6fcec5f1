"""Bursts of events in streams: restart of the timer, overflow, late events, restart of the query."""

import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repolytics.streaming import bursts

BASE = datetime(2026, 3, 1, 12)
EVENTS = "root string, path string, ts timestamp"


@pytest.fixture
def stream(spark, tmp_path):
    """send(rows) adds a file of (root, path, milliseconds); found() runs what there is and gives all bursts so far."""
    spark.conf.set(*bursts.STATE_STORE)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source, sink, n = tmp_path / "in", str(tmp_path / "out"), [0]
    source.mkdir()

    def send(*rows):
        n[0] += 1
        lines = [json.dumps({"root": r, "path": p, "ts": (BASE + timedelta(milliseconds=ms)).isoformat() + "Z"}) for r, p, ms in rows]
        (source / f"{n[0]:03}.json").write_text("\n".join(lines))
        os.utime(source / f"{n[0]:03}.json", (1_700_000_000 + n[0],) * 2)  # files come in this order

    def found(**options):
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
        query = bursts.buffered(events, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        ms = lambda at: round((at.replace(tzinfo=UTC) - BASE.replace(tzinfo=UTC)) / timedelta(milliseconds=1))
        rows = spark.read.parquet(sink).select("root", F.timestamp_millis(F.unix_millis("start")).alias("start"), "end", "events", "paths", "dropped").collect()
        return sorted((r["root"], ms(r["start"]), ms(r["end"]), r["events"], r["paths"], r["dropped"]) for r in rows)

    yield send, found
    spark.conf.unset(bursts.STATE_STORE[0])


def test_each_event_restarts_the_timer_and_order_does_not_matter(stream):
    send, found = stream
    send(("r", "b", 0), ("r", "a", 200), ("s", "x", 100))
    send(("r", "a", 600), ("r", "c", 400), ("r", "d", 2_000))
    send(("q", "end", 60_000))
    send(("q", "end", 61_000))
    assert found() == [("r", 0, 850, 4, ["a", "b", "c"], 0), ("r", 2_000, 2_250, 1, ["d"], 0), ("s", 100, 350, 1, ["x"], 0)]


def test_a_full_buffer_drops_the_oldest(stream):
    send, found = stream
    send(*(("r", f"p{i:02}", 10 * i) for i in range(30)))
    send(("q", "end", 60_000))
    send(("q", "end", 61_000))
    assert found(most=8) == [("r", 220, 540, 8, [f"p{i:02}" for i in range(22, 30)], 22)]


def test_late_events_are_left_out_and_a_restart_goes_on(stream):
    send, found = stream
    send(("r", "a", 0))
    send(("q", "far", 30_000))
    first = found()
    send(("r", "late", 100), ("r", "b", 29_900))
    send(("q", "end", 90_000))
    send(("q", "end", 91_000))
    done = found()
    assert first in ([], [("r", 0, 250, 1, ["a"], 0)])
    assert done == [("q", 30_000, 30_250, 1, ["far"], 0), ("r", 0, 250, 1, ["a"], 0), ("r", 29_900, 30_150, 1, ["b"], 0)]


def test_bursts_of_a_table(spark):
    rows = [("r", p, BASE + timedelta(milliseconds=ms)) for p, ms in (("b", 0), ("a", 200), ("a", 600), ("c", 400), ("d", 2_000))]
    got = bursts.bursts(spark.createDataFrame(rows, EVENTS)).orderBy("start").collect()
    assert [(r["events"], r["paths"]) for r in got] == [(4, ["a", "b", "c"]), (1, ["d"])]
