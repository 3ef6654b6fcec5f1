"""Operators on small inputs with known results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repolytics.functions import numeric, predicates, text
from repolytics.operators import boundaries, churn, ci, code, coupling, decay, gap, ownership, workspace
from repolytics.plans import health, history, risks
from repolytics.sources import facts, profiles, workflows, workspaces
from repolytics.streaming import watch

NOW = datetime(2026, 10, 6, 12)


def ago(days):
    return NOW - timedelta(days=days)


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_roundings_differ_on_purpose(spark):
    assert one(spark, numeric.round2(F.lit(1.005)), numeric.round2(F.lit(-1.239)), numeric.round_half(F.lit(2.5), 0), numeric.round_half(F.lit(-0.125), 2)) == (1.0, -1.24, 3.0, -0.13)
    assert one(spark, numeric.clamp01(F.lit(float("nan"))), numeric.clamp01(F.lit(7.0)), numeric.ratio(F.lit(1), F.lit(0))) == (0.0, 1.0, 0.0)


def test_decay_weight(spark):
    w = lambda days: one(spark, numeric.decay_weight(F.lit(ago(days)), F.lit(NOW), 90))
    assert w(0) == 1 and abs(w(90) - 0.5) < 1e-9 and 0 < w(365) < 0.5 and w(-5) == 1
    assert one(spark, numeric.age_days(F.lit(ago(1.99)), F.lit(NOW)), numeric.age_days(F.lit(ago(-3)), F.lit(NOW))) == (1, 0)


@pytest.mark.parametrize("path,test", [("ui/panel.spec.tsx", True), ("spec_util.rb", True), ("shop/e2e/pay.py", True), ("Test_Loud.PY", True), ("contest.py", False), ("lib/testing_tools.go", False), ("protest/march.rs", False)])
def test_test_paths(spark, path, test):
    assert one(spark, predicates.is_test_path(F.lit(path))) == test


def test_routes(spark):
    cases = {"/users/42": "/users/{id}", "/users/42/posts": "/users/{id}/posts", "/users/john": "/users/john", "/users/42?page=2": "/users/{id}", "/": "/", "/u/123e4567-e89b-12d3-a456-426614174000": "/u/{id}"}
    assert [one(spark, predicates.normal_route(F.lit(k))) for k in cases] == list(cases.values())


def test_globs_boundaries_and_names(spark):
    got = one(spark, *[predicates.matches_glob(F.lit(d), p) for p, d in [("shops/*", "shops/paris/stock"), ("libs/**", "libs/units/mass"), ("shops/closed/**", "shops/closed"), ("shops/closed/**", "shops/closedown")]])
    assert got == (False, True, True, False)
    assert one(spark, *[predicates.boundary_of(F.lit(p)) for p in ("shops/paris/till.ts", "run.go", "engine/a/b/c/cog.go")]) == ("shops", "", "engine")
    assert one(spark, *[predicates.python_requirement(F.lit(x)) for x in ("flask[async]==2.3", "Django_SQLAlchemy==1.4", "requests @ https://x/y.whl", "-r other.txt", "-e ./local", "https://x.whl")]) == ("flask", "django-sqlalchemy", "requests", None, None, None)
    assert one(spark, *[predicates.language_of(F.lit(p)) for p in ("a/b.GO", "x.vue", "README.md")]) == ("Go", "TypeScript", None)
    assert one(spark, *[predicates.severity_of_impact(F.lit(float(x))) for x in (0, 0.5, 2, 6, 12, 50)]) == ("low", "low", "medium", "high", "critical", "critical")


def test_numeric_guard(spark):
    assert one(spark, predicates.unsupported_numbers(F.lit("score 71.50 of 100, 3 risks, 42 files"), F.array(F.lit("71.5"), F.lit("100")))) == ["42"]


@pytest.mark.parametrize("line,n", [("if a && b || c {", 3), ("} else if b {", 1), ("format(x)", 0), ("#ifdef DEBUG", 0), ("if a { for x { } }", 2), ("case 1:", 1)])
def test_branches(spark, line, n):
    assert code.branches(line) == n == one(spark, code.branch_count(F.lit(line)))


def test_lines_are_stripped_in_order():
    assert code.strip_line("x := 1 // note", "Go", False) == ("x := 1", False, False)
    assert code.strip_line("/* note */ x := 1", "Go", False) == ("", True, False)
    assert code.strip_line("*/ x := 1", "Go", True) == ("x := 1", False, False)
    assert code.strip_line('*/ x := "if { && }"', "Go", True) == ('x := "         "', False, False)
    assert code.strip_line("still inside", "Go", True) == ("", True, True)
    assert code.strip_line("x = '#' # c", "Python", False) == ("x = ' '", False, False)
    assert code.blank_strings('s := "hello"', '"') == 's := "     "' and code.blank_strings('s := "a\\"b"', '"') == 's := "   "'
    assert code.blank_strings('m["{"] + n["}"]', '"') == 'm[" "] + n[" "]' and code.blank_strings('s := "open', '"') == 's := "    '


def test_scan_counts_units_and_nesting(spark):
    body = "package a\n// c\nfunc f() {\n  if x { for y { } }\n}\n/* block\nif if if\n*/\nfunc g() {\n  if z { }\n}\n"
    got = code.scan(body, "Go")
    assert got == {"total_lines": 11, "code_lines": 7, "functions": 2, "branch_points": 3, "max_function_branches": 2, "max_nesting": 3}
    row = code.measure(spark.createDataFrame([("a_test.go", "Go", body), ("b.yml", "YAML", "if: x")], "path string, language string, content string")).orderBy("path").collect()
    assert row[0]["complexity"] == 2.5 and row[0]["level"] == "low" and row[0]["is_test"] and not row[1]["complexity_measured"]


def changes(spark, rows):
    return spark.createDataFrame(rows, "commit string, at timestamp, author string, path string, added long, deleted long")


def test_churn(spark):
    frame = changes(spark, [("1", NOW, "a", "core/a.go", 10, 2), ("1", NOW, "a", "core/b.go", 5, 0), ("1", NOW, "a", "assets/logo.png", None, None), ("2", NOW, "a", "core/a.go", 1, 1)])
    got = {r["path"]: tuple(r)[1:] for r in churn.churn_by_path(frame).collect()}
    assert got == {"core/a.go": (2, 11, 3, 16), "core/b.go": (1, 5, 0, 6)}


@pytest.mark.parametrize("scores,value", [([10, 10, 10, 10], 0.0), ([97, 1, 1, 1], 0.92), ([], 0.0), ([5], 1.0), ([0, 0], 0.0)])
def test_concentration(spark, scores, value):
    assert churn.concentration(spark.createDataFrame([(s,) for s in scores], "score long")).first()["concentration"] == value


def test_ownership_prefers_the_recent_author(spark):
    rows = [(str(d), ago(d), "founder", "f.go", 1, 1) for d in range(320, 361, 5)] + [("now", ago(5), "current", "f.go", 1, 1)]
    owned = ownership.owners(changes(spark, rows), "path", NOW).orderBy("rank").collect()
    assert [(r["author"], r["weighted_share"], r["share"]) for r in owned] == [("current", 0.5934, 0.1), ("founder", 0.4066, 0.9)]
    frame = ownership.owners(changes(spark, rows), "path", NOW)
    assert ownership.bus_factor(frame).first()["bus_factor"] == 2
    assert ownership.risk(frame, NOW, history_days=10).first()["at_risk"] is None


def test_coupling_and_expansion(spark):
    rows = [(str(k), ago(k), "x", p, 1, 1) for k in range(3) for p in "ab"] + [(str(k), ago(k), "x", "c", 1, 1) for k in (3, 4)] + [("0", ago(0), "x", "a", 1, 1)]
    found = coupling.pairs(changes(spark, rows), min_shared=2, threshold=0.5)
    assert [(r["a"], r["b"], r["shared"], r["coupling"]) for r in found.collect()] == [("a", "b", 3, 1.0)]
    seeds = lambda *s: spark.createDataFrame([(x,) for x in s], "path string")
    assert [(r["path"], r["hops"], r["via"]) for r in coupling.expand(found, seeds("a")).collect()] == [("b", 1, "a")]
    assert coupling.expand(found, seeds("a", "b")).count() == coupling.expand(found, seeds()).count() == 0
    packages = spark.createDataFrame([("a", "p"), ("b", "q")], "path string, package string")
    none = spark.createDataFrame([], "src string, dst string")
    assert coupling.hidden(found, packages, none).count() == 1
    assert coupling.hidden(found, packages, spark.createDataFrame([("q", "p")], "src string, dst string")).count() == 0
    assert coupling.pairs(changes(spark, rows), 2, 0.5, max_paths=1).count() == 0


def test_decay(spark):
    frame = changes(spark, [("1", ago(200), "x", "old.go", 1, 1), ("2", ago(10), "x", "busy.go", 1, 1), ("3", ago(90), "x", "edge.go", 1, 1)])
    assert [(r["path"], r["age_days"]) for r in decay.orphans(frame, NOW).orderBy("path").collect()] == [("edge.go", 90), ("old.go", 200)]
    dated = lambda *days: spark.createDataFrame([(k, ago(d)) for k, d in enumerate(days)], "commit long, at timestamp")
    got = decay.half_life(dated(*(d for d in range(101, 201) for _ in range(3)), *range(1, 101)), NOW).first()
    assert got["prior_rate"] == 3.02 and got["recent_rate"] == 1.01 and abs(got["half_life_days"] - 62.78) < 0.01
    short = decay.half_life(dated(1, 2), NOW).first()
    assert short["half_life_days"] is None and short["reason"] == "history of 2 of 180 days"
    old = decay.half_life(dated(400, 380, 300, 280), NOW).first()
    assert old["history_days"] == 400 and old["half_life_days"] == 0 and old["reason"] is None
    assert decay.half_life(dated(), NOW).first()["reason"] == "no commits" and decay.half_life(dated(200, 200), NOW).first()["half_life_days"] is None
    names = changes(spark, [(str(k), ago(k), a, "s.go", 1, 1) for k, a in enumerate(["", "", "ann", "ann", "ann"])])
    assert decay.silos(names, 0.5).first()["share"] == 0.6 and decay.silos(names, 0.7).count() == 0


def test_gap_scores_and_buckets(spark):
    assert [round(one(spark, gap.critical_risk(F.lit(float(s)), F.lit(h))), 2) for s, h in ((50, 0), (50, 1), (50, 9), (50, 999), (0, 100))] == [0, 15.05, 50, 150, 0]
    records = spark.createDataFrame([("a/x.go", 400, 50.0, False, True), ("b/x.go", 1, 1.0, False, True), ("c/y.go", 400, 50.0, False, True), ("d/z.go", 1, 1.0, False, True), ("e/w.go", 1, 1.0, True, True)], "path string, code_lines long, complexity double, is_test boolean, complexity_measured boolean")
    seen = spark.createDataFrame([("lib/y.go", 9, 5), ("x.go", 3, 1)], "file string, hits long, latency_ns long")
    got = {r["path"]: (r["bucket"], r["hits"], r["ambiguous"]) for r in gap.entries(records, seen, 0.9).collect()}
    assert got == {"a/x.go": ("phantom", 0, True), "b/x.go": ("phantom", 0, True), "c/y.go": ("hot", 9, False), "d/z.go": ("phantom", 0, False)}
    assert {r["bucket"] for r in gap.entries(records, seen, 0.4).collect()} == {"hot", "debt"}


def test_size_score_falls_on_both_sides(spark):
    score = lambda avg: one(spark, health.code_score(F.lit(float(avg)), F.lit(0), F.lit(100), F.lit(40), F.lit(1)))
    assert score(100) == 100 and score(4) == score(1200) == 50


def test_history_views(spark):
    own = spark.createDataFrame([("r", i, s, k) for i, (s, k) in enumerate([(80.0, 1), (80.0, 1), (62.0, 3), (71.0, 2)])], "root string, id long, score double, risk_count long")
    assert [r["glyph"] for r in history.trend(own).orderBy("id").collect()] == ["●", "▬", "▼", "▲"]
    assert tuple(history.score_delta(own).first()) == ("r", 71.0, 62.0, 9.0, "improving")
    assert [r["id"] for r in history.page(own, "r", 2).collect()] == [2, 3] and history.prune(own, 3).count() == 3
    a, b = (spark.createDataFrame(x, "id string, impact double, severity string") for x in ([("p", 1.0, "low"), ("q", 5.0, "medium"), ("s", 1.0, "low")], [("q", 2.0, "medium"), ("n", 3.0, "medium"), ("s", 1.0, "low")]))
    assert sorted((r["id"], r["change"], r["better"]) for r in history.risk_changes(a, b).collect()) == [("n", "added", -1), ("p", "resolved", 1), ("q", "changed", 1)]


def test_gates_and_zero_bounds(spark):
    own = spark.createDataFrame([("r", 70.0, 1)], "root string, score double, risks long")
    assert [tuple(r) for r in risks.breaches(own, {"min_score": 75, "max_risks": 0, "max_score": None, "fail_on_drift": False}, ["root"]).collect()] == [("r", "max_risks", 1.0, 0.0), ("r", "min_score", 70.0, 75.0)]
    assert risks.breaches(own, {}, ["root"]).count() == 0


def test_cycles_and_prefix_joins(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y")], "src string, dst string")
    assert sorted(tuple(r) for r in boundaries.cycles(edges).collect()) == [("a", p, 4) for p in "abcd"]
    packages = spark.createDataFrame([("apps/web",), ("apps/web/ui",), ("apps/web-legacy",)], "path string")
    items = spark.createDataFrame([(1, "apps/web/ui/a.ts"), (2, "apps/web-legacy/b.ts"), (3, "lib/c.ts")], "id long, subject string")
    assert {r["id"]: r["package"] for r in workspace.attribute(items, packages, "subject", "id").collect()} == {1: "apps/web", 2: "apps/web-legacy", 3: None}
    assert workspace.nearest(items.select(F.col("subject").alias("path")), packages).filter("path like '%ui%'").first()["package"] == "apps/web/ui"


def test_manifests(spark):
    npm = one(spark, facts.npm_manifest(F.lit('{"dependencies":{"b":"1","a":"1"},"devDependencies":{"a":"1","c":"1"},"peerDependencies":{"p":"1"}}')))
    assert tuple(npm) == (3, 1, ["a", "b"])
    counts = one(spark, facts.npm_lock_count(F.lit('{"packages":{"":{},"x":{},"y":{}}}')), facts.yarn_lock_count(F.lit('a@1:\n  version "1"\n"b@2":\n# c:\n')), facts.go_sum_count(F.lit("mod/a v1 h1:x\nmod/a v1/go.mod h1:y\nmod/b v2 h1:z\n")), facts.poetry_lock_count(F.lit("[[package]]\nname='x'\n [[package]]\n")), facts.pipenv_lock_count(F.lit('{"default":{"a":{}},"develop":{"b":{},"c":{}}}')), facts.pnpm_lock_count(F.lit("lockfileVersion: 6\npackages:\n  /a@1:\n    dev: true\n  /b@2:\nother:\n  x:\n")))
    assert counts == (2, 2, 2, 2, 3, 2)
    assert tuple(one(spark, facts.go_mod(F.lit("module x\nrequire (\n\ta v1\n\tb v2 // indirect\n)\nrequire c v3\n")))) == (2, 1)
    assert one(spark, facts.requirements(F.lit("Flask==1\n# c\n-r x.txt\nflask>=2\nPy_Yaml\n"))) == ["flask", "py-yaml"]
    toml = spark.createDataFrame([("d", '[project]\ndependencies = ["A_b>=1", "c"]\n[project.optional-dependencies]\nt = ["c", "d"]\n'), ("e", "not = [toml")], "dir string, text string")
    assert [tuple(r)[1:] for r in facts.pyproject(toml).orderBy("dir").collect()] == [(1, 2, ["a-b", "c", "d"]), (0, 0, [])]
    files = spark.createDataFrame([("r", "go.mod", NOW), ("r", "go.sum", ago(1)), ("r", "package.json", NOW)], "dir string, file string, mtime timestamp")
    assert sorted((r["name"], r["drift"], r["stale"]) for r in facts.ecosystems(files).collect()) == [("go", False, True), ("npm", True, False)]


def test_logs_and_profiles(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("\x1eabc\x1fAnn\x1fa@x\x1f2026-01-01T00:00:00Z\n\n10\t2\tcore/a b.go\n-\t-\tlogo.png\n\x1edef\x1fBob\x1fb@x\x1f2026-01-02T00:00:00Z\n\n1\t1\tcore/a b.go\n")
    rows = sorted((r["commit"], r["author"], r["path"], r["added"]) for r in facts.git_log(spark, str(log)).collect())
    assert rows == [("abc", "Ann", "core/a b.go", 10), ("abc", "Ann", "logo.png", None), ("def", "Bob", "core/a b.go", 1)]
    lines = ['1.2.3.4 - - [06/Oct/2026:12:00:00 +0000] "GET /users/42 HTTP/1.1" 200 12 345', '1.2.3.4 - - [06/Oct/2026:12:00:01 +0000] "GET /users/7 HTTP/1.1" 200 12 9', "", "garbage"]
    got = facts.access_log(spark.createDataFrame([(x,) for x in lines], "value string")).groupBy("route").count().collect()
    assert {r["route"]: r["count"] for r in got} == {"/users/{id}": 2, None: 2}
    span = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"s","startTimeUnixNano":"5","endTimeUnixNano":"9","attributes":[{"key":"code.function.name","value":{"stringValue":"f"}}]}]}]}]}'
    assert tuple(facts.otel_spans(spark.createDataFrame([(span,)], "value string")).first())[:3] == ("f", None, 4)
    found = facts.otel_spans(spark.createDataFrame([("not json",), ('{"spans":[{"attributes":{"code.function.name":"g","code.file.path":"x.py"},"start_time":"2026-01-01T00:00:00Z","end_time":"2026-01-01T00:00:01Z"}]}',)], "value string"))
    assert [tuple(r)[:3] for r in found.collect()] == [("g", "x.py", 1_000_000_000)]


def test_source_files_prune_before_reading(spark, tmp_path):
    for name, text in (("a/x.go", 'package a\nimport (\n  "m/b"\n  "fmt"\n)\n'), ("vendor/y.go", "x"), ("b/big.py", "x" * 100), ("README.md", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = facts.source_files(spark, str(tmp_path), max_bytes=99)
    assert [(r["path"], r["language"]) for r in found.collect()] == [("a/x.go", "Go")]
    assert sorted(tuple(r) for r in facts.go_imports(found, "m").collect()) == [("m/a", "fmt"), ("m/a", "m/b")]


FLOW = """
name: build
on: {pull_request_target: {branches: [main]}}
permissions: write-all
jobs:
  j:
    permissions: {contents: write, pages: read}
    strategy: {matrix: {os: [a], v: [%s]}}
    steps:
      - uses: Actions/Checkout@main
        with: {ref: x}
      - {uses: actions/setup-node@v4, with: {cache: false}}
      - {uses: ./local}
  k:
    timeout-minutes: 3
    steps: [{uses: x/y@%s}, {uses: z}]
  l: {steps: [{run: x, timeout-minutes: 2}]}
""" % (", ".join(map(str, range(300))), "a" * 40)


def test_workflow_rules(spark):
    files = spark.createDataFrame([("w", FLOW), ("bad", "a: ["), ("list", "- a"), ("none", ""), ("null", None), ("odd", "jobs: 3\non: true")], "file string, text string")
    found = ci.findings(workflows.workflows(files))
    assert sorted((r["file"], r["job"], r["rule"], r["severity"]) for r in found.collect()) == sorted([
        ("bad", "", "unparseable_workflow", "high"), ("list", "", "unparseable_workflow", "high"), ("w", "", "write_all_permissions", "high"), ("w", "j", "write_scope", "medium"), ("w", "j", "privileged_trigger_checkout", "critical"),
        ("w", "j", "mutable_ref", "high"), ("w", "j", "mutable_ref", "medium"), ("w", "j", "missing_cache", "medium"), ("w", "j", "constant_matrix_axis", "low"), ("w", "j", "excessive_matrix", "medium"), ("w", "j", "missing_timeout", "low"), ("w", "k", "unpinned_action", "high"),
    ])
    assert ci.ordered(found).first()["severity"] == "critical"
    assert risks.workflow_breaches(found, "high").count() == 6 and risks.workflow_breaches(found, "none").count() == 0
    with pytest.raises(ValueError):
        risks.workflow_breaches(found, "severe")


def test_workspaces_by_marker(spark):
    assert workspaces.clean(["./a/*/", "!b", " ! ", "../out", ".", "/abs", None, "c"]) == (["a/*", "c"], ["b"])
    assert workspaces.declared("go.work", "go 1.22\nuse ./one\nuse (\n\t./two // x\n)\n") == (["one", "two"], [])
    assert workspaces.declared("package.json", '{"workspaces": ["x/*"]}') == (["x/*"], []) and workspaces.declared("package.json", "{") == ([], [])
    assert workspaces.declared("Cargo.toml", '[workspace]\nmembers = ["m"]') == (["m"], []) and workspaces.declared("pnpm-workspace.yaml", "packages: ['p', '!q']") == (["p"], ["q"])
    cases = [("a/*", "a/b", True), ("a/*", "a/b/c", False), ("a/**", "a", True), ("a/**/z", "a/x/y/z", True), ("a/**/z", "a/z", True), ("**", "x/y", True), ("**/k", "k", True), ("a.b/?", "axb/c", False), ("a.b/?", "a.b/c", True)]
    frame = spark.createDataFrame(cases, "glob string, dir string, hit boolean")
    assert frame.filter(F.regexp("dir", workspaces.glob_regex("glob")) != F.col("hit")).count() == 0


def test_package_health(spark):
    records = code.measure(spark.createDataFrame([("p/a.py", "Python", "x = 1\n" * 40), ("p/b/c.py", "Python", "if x:\n" * 500), ("q/d.go", "Go", "package d\n")], "path string, language string, content string"))
    packages = spark.createDataFrame([("p",), ("p/b",), ("q",)], "path string")
    moved = spark.createDataFrame([("p/b/c.py", 40, 2)], "path string, added long, deleted long")
    deps = spark.createDataFrame([("p", 10, True)], "package string, direct long, drift boolean")
    got = {r["package"]: r for r in workspace.health_of(records, packages, moved, deps).collect()}
    assert (got["p"]["files"], got["p"]["hotspots"], got["p/b"]["hotspots"], got["q"]["hotspots"]) == (2, 1, 1, 0)
    assert got["q"]["dependency_score"] == 90.0 and got["p"]["dependency_score"] == 84.0 and got["q"]["score"] > got["p/b"]["score"]


def test_findings_gates_and_severities(spark):
    stats = spark.createDataFrame([("a", 0, 0), ("b", 5, 0), ("c", 5, 1)], "root string, files long, test_files long")
    none = spark.createDataFrame([], "root string, confirmed boolean, reason string, path string")
    calm = spark.createDataFrame([], "root string, very_high_files long, max_complexity double, max_complexity_file string")
    got = risks.code_findings(none, stats, calm, keys=["root"])
    assert {(r["root"], r["title"]) for r in got.collect()} == {("a", "No source files detected"), ("b", "No test files detected")}
    with pytest.raises(ValueError):
        risks.filtered(stats, "grave")
    first = spark.createDataFrame([(60.0, 9.0, None, None)], "score double, avg_complexity double, previous_score double, previous_complexity double")
    assert [r["rule"] for r in risks.breaches(first, {"max_health_drop": 0, "max_complexity_increase": 8}, []).collect()] == ["max_complexity_increase"]


def test_words(spark):
    assert one(spark, text.signed(F.lit(0.25)), text.signed(F.lit(-2.0)), text.signed(F.lit(0.0)), text.short_sha(F.lit("a" * 40)), text.size_verdict(F.lit(20))) == ("+0.3", "-2", "0", "a" * 12, "files too fragmented")
    names = ["src/a.py", "a.py", ".env", "pkg/name", "@s/p.q", "/a.py", "c:\\x.py", "http://x/y.py", "x/.", "x.", ""]
    assert one(spark, *[text.looks_like_path(F.lit(x)) for x in names]) == (True, True, False, False, True, False, False, False, False, False, False)
    reason = text.hotspot_reason(F.lit("SQL"), F.lit(10), F.lit(3), F.lit(""), F.lit(False), F.lit(False))
    assert one(spark, reason) == "10 code lines; not confirmed: 10 of 500 lines, 3 of 30 changed lines, complexity not measured for SQL"
    assert one(spark, history.changed_line(F.array(*map(F.lit, "abcde")))).startswith("Detected 5 file changes (a, b, c, +2 more)")
    assert one(spark, profiles.stale_note(F.create_map(F.lit("commit"), F.lit("abc")), F.lit("abcdef"))) is None


def test_snapshots_against_the_last_in_a_stream(spark, tmp_path):
    kind = "root string, id long, score double"
    for at, rows in enumerate(([("r", 1, 50.0), ("q", 1, 70.0)], [("r", 2, 40.0)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(at)))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    seen = []
    query = watch.movements(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda frame, _: seen.extend(map(tuple, frame.collect()))).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(x[0] for x in seen) == ["q", "r", "r"] and any(x[4] in (-10.0, 10.0) for x in seen)


def test_polling_reports_what_changed(tmp_path):
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "node_modules").mkdir()
    rounds = watch.polled(str(tmp_path), 0.01)
    assert next(rounds) == []
    (tmp_path / "b.py").write_text("y")
    (tmp_path / "node_modules" / "c.py").write_text("z")
    assert next(rounds) == ["b.py"]


def test_bursts_in_a_stream(spark, tmp_path):
    base = datetime(2026, 1, 1)
    rows = [("r", "a.go", "write", base), ("r", "b.go", "write", base + timedelta(milliseconds=100)), ("r", "c.md", "write", base), ("r", "a.go", "write", base + timedelta(seconds=5)), ("q", "z.go", "create", base + timedelta(minutes=5))]
    spark.createDataFrame(rows, "root string, path string, op string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.relevant(spark.readStream.schema("root string, path string, op string, ts timestamp").parquet(str(tmp_path / "in")))
    seen = []
    query = watch.start(stream, lambda frame, _: seen.extend(tuple(r)[::3] for r in frame.collect()), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert sorted(seen) == [("r", 1), ("r", 2)]
