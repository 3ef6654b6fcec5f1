"""Drifted files and their rewrite against plain Python."""

import datetime
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq

from repolytics.llm import schema_drift
from repolytics.llm.queries import QUERIES
from tests.conftest import SF

NAMES = schema_drift.NAMES
KINDS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def field(name, value):
    if value is None:
        return "?"
    if name == "updated_at":
        return str((value - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1))
    if name == "balance":
        return str(math.floor(1048576 * value)) if math.isfinite(value) else str(value)
    return str(value)


def as_float(x):
    return x if x is None else float(np.float32(x))


def plain(rows, files=250):
    """What the contract says of rows (dicts), by file_no; rows of equal ids have no fixed order."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str("" if r["client_id"] is None else r["client_id"]).encode()), r["client_id"] or 0))
    each, out = 1 + len(rows) // files, {}
    for at in range(0, len(rows), each):
        file_no, own = at // each, [dict(r) for r in rows[at : at + each]]
        version = zlib.crc32(f"19:{file_no}".encode()) % 24
        version = 0 if version > 15 else version
        start = [n for n in NAMES if not (version & 4 and n in ("nation_id", "segment"))]
        if version & 1:
            start = [{"name": "email", "email": "name"}.get(n, n) for n in start]
        if version & 2:
            start = start[:1] + start[:0:-1]
        for r in own:
            if version & 4:
                r["nation_id"], r["segment"] = -1, "none"
            if version & 8:
                r["balance"] = as_float(r["balance"])
        texts = ["|".join(field(n, r[n]) for n in NAMES) for r in own]
        ids = ",".join(field("client_id", r["client_id"]) for r in own)
        out[file_no] = (version, len(own), sum(r[n] is None for r in own for n in NAMES), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256("\n".join(texts).encode()).hexdigest(), ",".join(start), ",".join(NAMES), version != 0, sorted(texts))
    return out


def compare(got, want, order=True):
    assert sorted(r["file_no"] for r in got) == sorted(want)
    for r in got:
        version, n, nulls, ids, texts, start, columns, rewritten, _ = want[r["file_no"]]
        assert (r["version"], r["n_rows"], r["start_columns"], r["columns"], r["rewritten"]) == (version, n, start, columns, rewritten)
        assert r["ids_sha256"] == ids
        if order:
            assert (r["n_nulls"], r["rows_sha256"]) == (nulls, texts)


def test_query_equals_plain_python(spark):
    got = QUERIES["op13_drift"](spark, SF).collect()
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/clients.parquet").collect()]
    compare(got, plain(rows))
    folder = os.path.dirname(got[0]["path"])
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(r["path"]) for r in got)
    versions = {r["version"] for r in got}
    assert len(versions) == 16
    for r in got[::20]:
        schema = pq.read_schema(r["path"])
        assert [int(f.metadata[b"PARQUET:field_id"]) for f in schema] == list(range(1, 11))
        assert schema.types == [kind for _, _, kind in schema_drift.COLUMNS] and all(f.nullable for f in schema)
        assert ("/start-" in r["path"]) == (not r["rewritten"])


def test_starting_files_drift_by_version(spark, tmp_path):
    clients = spark.read.parquet(f"{SF}/clients.parquet")
    rows, total = schema_drift.ranked(clients)
    folder = f"file://{tmp_path}/start"
    schema_drift.make_folder(folder)
    for r in schema_drift.write_start(rows, total, folder).collect():
        schema = pq.read_schema(r["path"].removeprefix("file://"))
        want = schema_drift.drifted(r["version"])
        assert [(int(f.metadata[b"PARQUET:field_id"]), f.name, f.type) for f in schema] == want
    assert schema_drift.drifted(0)[0][1] == "client_id" and [n for _, n, _ in schema_drift.drifted(2)] == NAMES[:1] + NAMES[:0:-1]
    assert [(i, n) for i, n, _ in schema_drift.drifted(1)][4:6] == [(5, "email"), (6, "name")]


def test_ranks_are_exact_with_hot_ids_and_copies(spark):
    r = random.Random(8)
    ids = [7] * 900 + [None] * 300 + [r.randint(0, 500) for _ in range(900)] + [10**15, -3]
    rows = [(i, r.randint(0, 3) if i == 7 else 1, "s", None, r.choice("ab") if i == 7 else None, None, "c", None, "x", r.choice([1.5, None, -0.25])) for i in ids]
    frame = spark.createDataFrame(rows, KINDS).repartition(5)
    found, total = schema_drift.ranked(frame)
    got = sorted(((x["rank"], x["copies"], x["client_id"]) for x in found.collect()))
    assert total == len(rows)
    at = 0
    for rank, copies, _ in got:
        assert rank == at
        at += copies
    assert at == len(rows)
    order = [(zlib.crc32(str("" if i is None else i).encode()), i is not None, i or 0) for rank, copies, i in got for _ in range(copies)]
    assert order == sorted(order)
    result = schema_drift.evolve(frame).collect()
    want = plain([dict(zip(NAMES, x)) for x in rows])
    compare(result, want, order=False)
    again = sorted((x["file_no"], x["rows_sha256"]) for x in schema_drift.evolve(frame.repartition(2)).collect())
    assert again == sorted((x["file_no"], x["rows_sha256"]) for x in result)


def test_odd_rows(spark):
    rows = [(1, None, "x" * 200_000, None, "", "é|\n", None, 3, None, float("nan")), (2, 2, None, datetime.datetime(1969, 12, 31, 23, 59, 59, 5), None, None, None, None, None, float("inf")), (2, 2, None, datetime.datetime(1969, 12, 31, 23, 59, 59, 5), None, None, None, None, None, float("inf")), (3, 1, "s", None, "n", "e", "c", 1, "g", 1e300)]
    frame = spark.createDataFrame(rows, KINDS).selectExpr("*", "1 as rank", "'y' as bucket", "2 as path", "0L as copies")
    wide = [dict(zip(NAMES, r)) for r in rows]
    got = schema_drift.evolve(frame).collect()
    assert sum(r["n_rows"] for r in got) == 4
    compare(got, plain(wide))
    assert schema_drift.evolve(frame.limit(0)).collect() == []
    nothing = spark.createDataFrame([(None,) * 10] * 3, KINDS)
    assert [(r["n_rows"], r["ids_sha256"]) for r in schema_drift.evolve(nothing).orderBy("file_no").collect()] == [(1, hashlib.sha256(b"?").hexdigest())] * 3
