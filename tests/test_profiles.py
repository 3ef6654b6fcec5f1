"""pprof decoding and the lexical function scan."""

import gzip

from pyspark.sql import functions as F

from repolytics.operators import cognitive
from repolytics.sources import profiles


def var(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def field(number, value):
    return var(number << 3) + var(value) if isinstance(value, int) else var(number << 3 | 2) + var(len(value)) + value


def profile():
    strings = ["", "samples", "count", "cpu", "nanoseconds", "main.f", "src/a.go", "main.g"]
    out = field(1, field(1, 1) + field(2, 2)) + field(1, field(1, 3) + field(2, 4))
    out += field(2, field(1, var(1) + var(2)) + field(2, var(3) + var(3000))) + field(2, field(1, 2) + field(2, 1) + field(2, 500)) + field(2, field(2, var(1) + var(7)))
    out += field(4, field(1, 1) + field(4, field(1, 1))) + field(4, field(1, 2) + field(4, field(1, 2)))
    out += field(5, field(1, 1) + field(2, 5) + field(4, 6)) + field(5, field(1, 2) + field(2, 7))
    return out + b"".join(field(6, s.encode()) for s in strings) + field(9, 123)


def test_pprof_attributes_leaf_frames(spark):
    got = profiles.decode(gzip.compress(profile()))
    assert got["samples"] == [("main.f", "src/a.go", 3, 3000), ("main.g", None, 1, 500), (None, None, 1, 7)] and got["time_nanos"] == 123
    rows = spark.createDataFrame([("a", bytearray(gzip.compress(profile()))), ("b", bytearray(b"\x1f\x8bjunk")), ("c", None)], "path string, content binary")
    found = profiles.pprof(rows)
    assert found.filter("error is not null").count() == 1
    own = profiles.summary(found.filter("error is null")).first()
    assert (own["observations"], own["attributed"], own["coverage"]) == (5, 4, 0.8)


def test_formats_are_told_apart(spark):
    rows = [("x.json", b'{"resourceSpans": []}'), ("p", gzip.compress(b"x")), ("q.pprof", b"x"), ("log", b'1.1.1.1 - - [x] "GET / HTTP/1.1" 200 5'), ("z", b"hello")]
    frame = spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "path string, content binary")
    assert {r[0]: r[1] for r in frame.select("path", profiles.kind_of("content", "path")).collect()} == {"x.json": "otel", "p": "pprof", "q.pprof": "pprof", "log": "accesslog", "z": "unknown"}


def test_profiles_of_any_kind_are_loaded(spark):
    rows = [("x.json", b'[{"durationNanos": 5, "code": {"function": {"name": "f"}}}, {"durationNanos": 2}]'), ("p", gzip.compress(profile())), ("a.log", b'1.1.1.1 - - [x] "GET /u/7 HTTP/1.1" 200 5 9\nnoise'), ("z", b"hello"), ("e", b"")]
    found = profiles.load(spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "path string, content binary")).collect()
    got = sorted((r["profile"], str(r["function"]), r["latency_ns"], r["error"] is None) for r in found)
    assert got == sorted([("x.json", "f", 5, True), ("x.json", "None", 2, True), ("p", "main.f", 3000, True), ("p", "main.g", 500, True), ("p", "None", 7, True), ("a.log", "/u/{id}", 9000, True), ("a.log", "None", 0, True), ("z", "None", 0, False), ("e", "None", 0, False)])


def test_functions_are_measured(spark):
    text = "package a\n\nfunc first(a int) int {\n\tx := g(a)\n\tif x > 1 {\n\t\th(x)\n\t}\n\treturn x\n}\n\nfunc (r *T) second() {\n}\n"
    got = cognitive.functions_in(text, "Go")
    assert [(f["name"], f["line"], f["lines"], f["lifetime"], f["calls"], f["depth"]) for f in got] == [("first", 3, 7, 4, 2, 2), ("second", 11, 2, 0, 0, 0)]
    files = spark.createDataFrame([("a.go", "Go", text), ("b.py", "Python", "def f(): pass"), ("c.ts", "TypeScript", "const go = (a) => {\n  let y = a;\n  run(y);\n}\n")], "path string, language string, content string")
    found = cognitive.functions(files)
    assert sorted((r["path"], r["name"]) for r in found.collect()) == [("a.go", "first"), ("a.go", "second"), ("c.ts", "go")]
    assert cognitive.files(found).filter(F.col("score") >= 0).count() == 2
    assert cognitive.call_targets and sorted(spark.range(1).select(cognitive.call_targets(F.lit("f(g(x), a.b (y))"))).first()[0]) == ["a.b", "f", "g"]
