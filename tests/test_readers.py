"""The pruning reader, stored documents and functions of SQL."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from repolytics.functions import sql
from repolytics.sources import facts, snapshots, tree


def made(root):
    for path, data in {"a.py": b"x = 1\n", "core/b.go": b"package core\n", "core/deep/c.ts": b"y\n" * 50, "core/bad.py": b"\xff\xfe\xff", "node_modules/m/d.js": b"z", "core/vendor/e.go": b"w", "read.me": b"no", "big.c": b"k" * 5000}.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_bytes(data)


def test_ignored_folders_are_never_listed(tmp_path, monkeypatch):
    made(tmp_path)
    seen, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (seen.append(os.path.relpath(p, tmp_path)), scandir(p))[1])
    reader = tree.Tree({"path": str(tmp_path), "partitionBytes": "1"}).reader(None)
    parts = reader.partitions()
    assert sorted(seen) == [".", "core", "core/deep"] and len(parts) == 5
    assert sorted(f[0] for p in parts for f in p.files) == ["a.py", "big.c", "core/b.go", "core/bad.py", "core/deep/c.ts"]
    assert list(reader.pushFilters([tree.In(("language",), ("Go", "C")), tree.EqualTo(("path",), "x")])) == [tree.EqualTo(("path",), "x")]
    assert sorted(f[0] for p in reader.partitions() for f in p.files) == ["big.c", "core/b.go"]


def test_the_reader_gives_what_the_file_source_gives(spark, tmp_path):
    made(tmp_path)
    found = tree.source_tree(spark, str(tmp_path), maxBytes="4000")
    got = {r["path"]: (r["language"], r["bytes"], r["content"], r["problem"]) for r in found.collect()}
    assert got["big.c"] == ("C", 5000, None, "truncated") and got["core/bad.py"][2:] == (None, "skipped")
    want = {r["path"]: (r["language"], r["bytes"], r["content"], None) for r in facts.source_files(spark, str(tmp_path), 4000).filter("path <> 'core/bad.py'").collect()}
    assert {p: v for p, v in got.items() if v[3] is None} == want
    gaps = facts.scan_gaps(spark, str(tmp_path), 4000).first()
    assert found.agg(F.count_if(F.col("problem") == "truncated"), F.count_if(F.col("problem") == "skipped")).first() == tuple(gaps)
    assert tree.source_tree(spark, str(tmp_path / "core" / "deep"), ignored="").count() == 1


def test_documents_of_two_versions_are_read_alike(spark, tmp_path):
    at = datetime(2026, 1, 2)
    rows = spark.createDataFrame([("r", "1", at, 70.5, "C", 3), ("q", "1", at, 80.0, "B", 0)], "root string, schema_version string, recorded_at timestamp, score double, grade string, files long")
    risks = spark.createDataFrame([("r", "x", 2.0, "low", "a"), ("r", "y", 7.0, "high", "b")], "root string, id string, impact double, severity string, subject string")
    folder = str(tmp_path / "docs")
    snapshots.write_documents(snapshots.documents(rows, risks), folder)
    newer = '{"schema_version": "2", "health": {"score": 91, "grade": "A"}, "measures": {"files": 5}, "risks": {"items": [{"id": "z", "impact": 1, "severity": "low"}]}}'
    snapshots.write_documents(spark.createDataFrame([("s", newer), ("t", '{"risks": "none"}')], "root string, j string").select("root", F.parse_json("j").alias("doc")), folder)
    stored = spark.read.parquet(folder)
    assert dict(stored.dtypes)["doc"] == "variant"
    assert sorted(map(tuple, snapshots.stored_risks(stored).collect())) == [("r", "x", 2.0, "low"), ("r", "y", 7.0, "high"), ("s", "z", 1.0, "low")]
    assert sorted(map(tuple, snapshots.stored_measures(stored, ["files"]).collect()), key=str) == [("q", "1", 80.0, "B", 0.0), ("r", "1", 70.5, "C", 3.0), ("s", "2", 91.0, "A", 5.0), ("t", None, None, None, None)]


def test_functions_of_sql(spark):
    sql.register(spark)
    one = spark.sql("SELECT churn_concentration(array(10L, 0L)) a, churn_concentration(array(1L, 1L)) b, churn_concentration(array(5L)) c, bus_factor(array(0.2D, 0.5D, 0.3D), 0.7D) d, bus_factor(array(), 0.7D) e, decay_weight(TIMESTAMP '2026-01-01', TIMESTAMP '2026-04-01', 90D) f").first()
    assert tuple(one) == (1.0, 0.0, 1.0, 2, 0, 0.5)
    rows = [("p", "C", i, t) for i, t in enumerate(["a /* not", "/* b", "c */ d", "// e", "", "f"])] + [("q", "Python", 0, "/* no")]
    spark.createDataFrame(rows, "path string, language string, number int, line string").createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT * FROM line_kinds(TABLE(some_lines) PARTITION BY path ORDER BY number)").orderBy("path", "number").collect()
    assert [r["kind"] for r in got] == ["code", "comment", "code", "comment", "blank", "code", "code"] and got[2]["code"] == "d"
