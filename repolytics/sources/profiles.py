"""Runtime profiles: format detection, pprof decoding, profile headers.

A pprof file is one gzip-compressed protocol-buffer message.  Executors decode it to
sample rows (leaf function only, as attribution needs no more); sums are Spark's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from repolytics.functions.numeric import col
from repolytics.sources.facts import access_log, otel_spans

# Field numbers of the public pprof message.
SAMPLE_TYPE, SAMPLE, LOCATION, FUNCTION, STRINGS, TIME_NANOS, DURATION_NANOS = 1, 2, 4, 5, 6, 9, 10
NANOSECONDS = {"nanoseconds": 1, "microseconds": 1_000, "milliseconds": 1_000_000, "seconds": 1_000_000_000}


def _text(content) -> Column:
    """Bytes as UTF-8; those that are not, as a character cut in two, are replaced."""
    return F.make_valid_utf8(col(content).cast("string"))


def kind_of(content, path) -> Column:
    """pprof, otel, accesslog or unknown: by magic, then markers, then extension, then shape."""
    head = _text(F.substring(col(content), 1, 4096))
    name = F.lower(col(path))
    return (
        F.when(F.hex(F.substring(col(content), 1, 2)) == "1F8B", "pprof")
        .when(head.rlike(r'^\s*[\[{]') & head.rlike('"(resourceSpans|resource_spans|scopeSpans|spans|traceId|spanId|trace_id|span_id|kind|startTimeUnixNano|durationNanos|duration_nanos)"'), "otel")
        .when(name.rlike(r"\.(log|txt|access)$"), "accesslog")
        .when(name.rlike(r"\.(pb|pprof)$"), "pprof")
        .when(head.rlike(r'"[A-Z]+ \S+( HTTP/[0-9.]+)?" \d{3} '), "accesslog")
        .otherwise("unknown")
    )


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift > 63:
            raise ValueError("a varint is too long")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers as they stand, length-delimited as bytes."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(raw, at)
        elif wire == 2:
            size, at = varint(raw, at)
            if at + size > len(raw):
                raise ValueError("a field runs past its message")
            value, at = raw[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = int.from_bytes(raw[at : at + size], "little"), at + size
        else:
            raise ValueError(f"wire type {wire} is not supported")
        yield number, value


def numbers(value: int | bytes) -> list[int]:
    """A repeated integer field: one value, or packed ones."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        one, at = varint(value, at)
        out.append(one)
    return out


def decode(raw: bytes) -> dict:
    """samples (function, file, hits, latency_ns), time_nanos and duration_nanos of a profile."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    types, samples, lines, functions, strings, times = [], [], {}, {}, [], {}
    for number, value in fields(raw):
        if number == SAMPLE_TYPE:
            types.append(dict(fields(value)))
        elif number == SAMPLE:
            places, values = [], []
            for n, v in fields(value):
                (places if n == 1 else values if n == 2 else []).extend(numbers(v) if n in (1, 2) else [])
            samples.append((places, values))
        elif number == LOCATION:
            own = list(fields(value))
            leaf = next((dict(fields(v)).get(1) for n, v in own if n == 4), None)
            lines[dict((n, v) for n, v in own if n == 1).get(1)] = leaf
        elif number == FUNCTION:
            own = dict(fields(value))
            functions[own.get(1)] = (own.get(2, 0), own.get(4, 0))
        elif number == STRINGS:
            strings.append(value.decode("utf-8", "replace"))
        elif number in (TIME_NANOS, DURATION_NANOS):
            times[number] = value
    text = lambda i: strings[i] if 0 <= i < len(strings) else ""
    units = [(text(t.get(1, 0)), text(t.get(2, 0))) for t in types]
    hit = next((i for i, (_, unit) in enumerate(units) if unit == "count"), 0)
    slow = next((i for i, (_, unit) in enumerate(units) if unit in NANOSECONDS), None)
    out = []
    for places, values in samples:
        name, file = (text(i) for i in functions.get(lines.get(places[0] if places else None), (0, 0)))
        latency = values[slow] * NANOSECONDS[units[slow][1]] if slow is not None and slow < len(values) else 0
        out.append((name or None, file or None, values[hit] if hit < len(values) else 1, latency))
    return {"samples": out, "time_nanos": times.get(TIME_NANOS), "duration_nanos": times.get(DURATION_NANOS)}


def _decode(batches):
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["profile", "function", "file", "hits", "latency_ns", "error"]
    for batch in batches:
        rows = []
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                rows += [(path, *s, None) for s in decode(raw or b"")["samples"]]
            except (ValueError, IndexError, zlib.error) as error:
                rows.append((path, None, None, 0, 0, str(error)))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def pprof(files: DataFrame) -> DataFrame:
    """profile, function, file, hits, latency_ns, error: a row for each sample of files (path, content)."""
    return files.select("path", "content").mapInArrow(_decode, "profile string, function string, file string, hits long, latency_ns long, error string")


def summary(samples: DataFrame, key: str = "profile") -> DataFrame:
    """key, observations, attributed, coverage of sample rows (function null: not resolved)."""
    sums = samples.groupBy(key).agg(F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("observations"), F.coalesce(F.sum(F.when(F.col("function").isNotNull(), F.col("hits"))), F.lit(0)).cast("bigint").alias("attributed"))
    return sums.withColumn("coverage", F.coalesce(F.try_divide(F.col("attributed").cast("double"), F.col("observations").cast("double")), F.lit(0.0)))


SAMPLES = "profile string, function string, file string, hits long, latency_ns long, error string"
VERSION_LABELS = ("service.version", "version", "build_id", "commit")


def load(files: DataFrame) -> DataFrame:
    """profile, function, file, hits, latency_ns, error of profiles of any known kind (path, content).

    Each file is read by its kind; an empty file or one of no known kind is one row with
    an error.  Lines of an access log that do not parse are observations without a function.
    """
    kinds = files.select("path", "content", kind_of("content", "path").alias("kind"))
    text = _text("content")
    empty = F.length("content") == 0
    bad = kinds.filter(empty | (F.col("kind") == "unknown")).select(F.col("path").alias("profile"), F.lit(None).cast("string").alias("function"), F.lit(None).cast("string").alias("file"), F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("latency_ns"), F.when(empty, "the file is empty").otherwise("not a known kind of profile").alias("error"))
    sound = kinds.filter(~empty)
    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("string")
    spans = otel_spans(sound.filter("kind = 'otel'").select("path", text.alias("value")), keep=("path",)).select(F.col("path").alias("profile"), "function", "file", one.alias("hits"), "latency_ns", none.alias("error"))
    lines = sound.filter("kind = 'accesslog'").select("path", F.explode(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).alias("value"))
    routes = access_log(lines, keep=("path",)).select(F.col("path").alias("profile"), F.col("route").alias("function"), none.alias("file"), one.alias("hits"), F.coalesce(F.col("micros") * 1000, F.lit(0)).cast("bigint").alias("latency_ns"), none.alias("error"))
    return bad.unionByName(pprof(sound.filter("kind = 'pprof'"))).unionByName(spans).unionByName(routes)


def stale_note(labels, build) -> Column:
    """Why a profile (labels: a map) and the analysed tree (its version, "" unknown) may be of different builds; null where nothing says so."""
    labels, build = col(labels), col(build)
    found = F.coalesce(*[F.when(F.coalesce(F.try_element_at(labels, F.lit(k)), F.lit("")) != "", F.struct(F.lit(k).alias("key"), F.try_element_at(labels, F.lit(k)).alias("value"))) for k in VERSION_LABELS])
    alike = build.contains(found["value"]) | found["value"].contains(build)
    told = F.concat(F.lit("the profile records "), found["key"], F.lit("="), found["value"])
    return F.when(found.isNull(), None).when(build == "", F.concat(told, F.lit(", the tree's version is unknown"))).when(~alike, F.concat(told, F.lit(", the tree is "), build))
