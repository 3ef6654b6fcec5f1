"""The entry points over one small repository, and reports of their results."""

import json
import subprocess
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repolytics import __main__ as main, api, server, settings
from repolytics.operators import gap, workspace
from repolytics.plans import reports
from repolytics.sources import facts, snapshots

NOW = datetime(2026, 10, 6, 12)


@pytest.fixture(scope="module")
def repository(spark):
    body = "package a\nfunc f() {\n" + "  if a && b || c { for x { } }\n" * 600 + "}\n"
    files = spark.createDataFrame([("core/big.go", "Go", body), ("core/small.go", "Go", "package a\n"), ("core/small_test.go", "Go", "package a\n")], "path string, language string, content string")
    rows = [(str(d), NOW - timedelta(days=d), "ann" if d % 3 else "bob", p, 20, 1) for d in range(1, 60, 2) for p in ("core/big.go", "core/small.go")]
    commits = spark.createDataFrame(rows, "commit string, at timestamp, author string, path string, added long, deleted long")
    ecosystems = spark.createDataFrame([("go", "go.mod", "go.sum", 3, 9, False, False), ("npm", "package.json", None, 10, 200, True, False)], "name string, manifest string, lockfile string, direct long, transitive long, drift boolean, stale boolean")
    return files, commits, ecosystems


def test_analysis_finds_the_hotspot(repository):
    got = api.analyze(*repository, NOW)
    assert [(r["path"], r["confirmed"]) for r in got["hotspots"].collect()] == [("core/big.go", True)]
    ids = [r["id"] for r in got["risks"].collect()]
    assert "code.hotspot.core/big.go" in ids and "dependency.drift.npm" in ids and "dependency.transitive.npm" in ids
    total = got["total"].first()
    assert 0 < total["score"] < 100 and total["grade"] in "ABCDF"
    assert "core/big.go" in reports.markdown(got["hotspots"], "Hotspots") and str(total["grade"]) in reports.status(got["total"], got["risks"])
    assert {r["title"] for r in got["findings"].collect()} >= {"Confirmed hotspot", "Missing lockfile for package.json"}
    shot = api.snapshot(got, "r", NOW, "abc", "2")
    row = shot.first()
    assert (row["score"], row["risk_count"], row["confirmed_hotspots"], row["dependency_drift"]) == (total["score"], len(ids), 1, True)
    assert set(shot.columns) == {f.split()[0] for f in snapshots.SCHEMA.split(", ")}
    got["records"].unpersist()


def test_history_view_keeps_the_newest():
    records = [{"id": i, "score": 50.0 + i, "risk_count": i, "avg_complexity": 2.0} for i in range(5)]
    found = server.history_view(records, "3")
    assert [r["id"] for r in found["records"]] == [2, 3, 4] and found["delta"] == {"score": 2.0, "complexity": 0.0, "risks": 2}


def test_command_line_over_a_repository(spark, tmp_path, capsys):
    root = tmp_path / "repo"
    (root / "core").mkdir(parents=True)
    (root / "core" / "a.py").write_text("def f():\n    if x:\n        return 1\n")
    (root / "package.json").write_text('{"name": "n", "dependencies": {"a": "1"}}')
    (root / ".github" / "workflows").mkdir(parents=True)
    (root / ".github" / "workflows" / "w.yml").write_text("on: push\njobs: {j: {steps: [{uses: a/b@main}]}}\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    git("checkout", "-qb", "side")
    (root / "core" / "b.py").write_text("y = 2\n" * 30)
    git("add", ".")
    git("commit", "-qm", "two")
    git("checkout", "-q", "-")
    (root / "core" / "c.js").write_text("function a() {\n  b(1);\n}\n")
    (root / "go.mod").write_text("module m\n")
    (root / "core" / "d.go").write_text("package core\n\nimport \"m/ui\"\n\nfunc f() {\n\tx := 1\n\tg(x)\n}\n")
    git("add", ".")
    git("commit", "-qm", "three")
    git("merge", "-q", "--no-ff", "-m", "both", "side")
    run = lambda *a: main.run(main.options([a[0], str(root), *a[1:]] if a[0] != "version" else ["version"]))
    assert run("version") == 0 and run("status") == 0
    assert "risk(s)" in capsys.readouterr().out
    (root / "core" / "b.py").write_text("z = 3\n")
    assert run("blast") == 0 and run("decay") == 0 and run("setup") == 0
    assert "git_window_days: 7" in capsys.readouterr().out
    assert run("analyze", "--format", "json", "--only", "git") == 0
    git_row = json.loads(capsys.readouterr().out)["git"]
    assert (git_row["commits"], git_row["window_commits"], git_row["authors"], git_row["lines_added"]) == (4, 4, 1, 48)
    assert run("compare", "--base", "HEAD~1") == 0 and "Code lines" in capsys.readouterr().out
    assert run("topology", "--only", "gates", "violations") == 0 and "4 of 10 commits" not in capsys.readouterr().out
    assert run("cognitive", "--format", "json") == 0
    found = json.loads(capsys.readouterr().out)
    assert [(r["path"], r["failed"]) for r in found["files"]] == [("core/c.js", True), ("core/d.go", False)] and found["summary"]["worst"] > 0
    assert run("explain") == 0 and run("history") == 0 and "no history" in capsys.readouterr().out
    profile = tmp_path / "access.log"
    profile.write_text('1.1.1.1 - - [x] "GET /u/7 HTTP/1.1" 200 5 9\n')
    assert run("gap", "--profile", str(profile)) == 0 and run("watch", "--rounds", "1") == 0


def test_a_clean_repository_has_few_risks(spark, repository):
    files = spark.createDataFrame([(f"core/f{i}{'_test' * (i % 3 == 0)}.go", "Go", "x = 1\n" * 100) for i in range(30)], "path string, language string, content string")
    clean = api.analyze(files, repository[1], repository[2].limit(0), NOW)
    assert not [r for r in clean["risks"].collect() if r["severity"] in ("high", "critical")]
    assert clean["total"].first()["score"] > api.analyze(*repository, NOW)["total"].first()["score"]


def test_empty_repository(spark, repository):
    got = api.analyze(*(f.limit(0) for f in repository), NOW)
    assert got["total"].first()["score"] == 90.0 and got["hotspots"].count() == 0


def test_topology_and_blast(spark, repository):
    _, commits, _ = repository
    imports = spark.createDataFrame([], "src string, dst string")
    packages = spark.createDataFrame([("core", "core")], "package string, boundary string")
    got = api.topology(commits, imports, packages, NOW)
    assert got["coupling"].count() == 1 and got["hidden"].count() == 0 and got["bus_factor"].count() == 2
    assert {r["gate"]: r["passed"] for r in got["gates"].collect()} == {"coupling": True, "ownership": True, "half_life": False}
    named = spark.createDataFrame([("m/core", "core"), ("m/ui", "ui")], "package string, boundary string")
    import_of = lambda *e: spark.createDataFrame(list(e), "src string, dst string")
    moved = commits.withColumn("path", F.replace("path", F.lit("core/small"), F.lit("ui/small")))
    for edges, n in (([("m/ui", "m/core")], 0), ([("m/core", "fmt")], 1)):
        own = api.topology(moved, import_of(*edges), named, NOW, "m")
        assert own["hidden"].count() == n and [r["same_boundary"] for r in own["coupling"].collect()] == [False]
    young = api.topology(commits.filter(F.col("at") >= NOW - timedelta(days=8)), imports, packages, NOW)
    assert young["coupling"].count() == 0 and [(r["at_risk"], r["reason"]) for r in young["risk"].collect()] == [(None, "history of 7 of 30 days: every author is recent")] * 2
    assert {r["gate"]: r["reason"] for r in young["gates"].collect()}["coupling"] == "4 of 10 commits: a ratio of so few is no relationship"
    seeds = spark.createDataFrame([("core/big.go",)], "path string")
    assert [r["path"] for r in api.blast(commits, seeds).collect()] == ["core/small.go"] and api.blast(commits, seeds, min_commits=1000).count() == 0
    assert api.decayed(commits, NOW)["orphans"].count() == 0


def test_snapshot_history(spark, tmp_path):
    rows = spark.createDataFrame([("0.2", "r", NOW, 70.0), ("0.2", "r", NOW + timedelta(days=1), 75.0)], "schema_version string, root string, recorded_at timestamp, score double")
    for _ in range(2):
        snapshots.append(rows, str(tmp_path / "h"))
    assert sorted(r["id"] for r in snapshots.history(spark, str(tmp_path / "h")).collect()) == [1, 2, 3, 4]
    snapshots.write_json(rows.coalesce(1), str(tmp_path / "j"))
    assert "●" in reports.timeline(snapshots.history(spark, str(tmp_path / "h"))) and reports.axis(70, 75) == (60.0, 90.0)
    (tmp_path / "bad.json").write_text('{"root": "r"}')
    with pytest.raises(Exception, match="schema_version"):
        snapshots.read(spark, str(tmp_path / "bad.json")).collect()


def test_settings_of_file_environment_and_options(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    (tmp_path / ".repolytics.yml").write_text("git_window_days: 30\nmin_health_score: 0\nignore_dirs: [x, y]\nunknown: 1\nmax_hotspots: many\n")
    found, warnings = settings.load(str(inner), {"REPOLYTICS_GIT_WINDOW_DAYS": "60", "REPOLYTICS_FAIL_ON_DRIFT": "true"}, max_risk_count=4, history_limit=None)
    assert (found["git_window_days"], found["min_health_score"], found["ignore_dirs"], found["fail_on_drift"], found["max_risk_count"], found["history_limit"]) == (60, 0.0, ["x", "y"], True, 4, 10)
    assert found["max_hotspots"] is None and warnings == ["max_hotspots: 'many' is left out"]
    settings.check(found)
    with pytest.raises(ValueError, match="git_window_days"):
        settings.check(found | {"git_window_days": 0})
    (tmp_path / ".repolytics.yml").write_text("- no mapping")
    plain, warnings = settings.load(str(inner), {})
    assert plain["git_window_days"] == 90 and len(warnings) == 1
    assert settings.load(str(inner), {}, path=str(tmp_path / "none"))[1]


def test_packages_pruned_folders_and_order_by_effort(spark):
    own = spark.createDataFrame([("p", 30.0, 95.0), ("q", 95.0, 100.0)], "package string, code_score double, dependency_score double")
    assert [(r["package"], r["key"], r["severity"]) for r in workspace.risks_of(own).collect()] == [("p", "code", "critical")]
    files = spark.createDataFrame([("a/x.go", 'import "m/b"'), ("vendor/v/y.go", 'import "m/b"'), ("b/testdata/z.go", 'import "m/a"'), ("dist.go", "package m")], "path string, content string")
    assert sorted(map(tuple, facts.go_imports(files, "m").collect())) == [("m/a", "m/b")]
    assert sorted(r["package"] for r in facts.go_packages(files, "m").collect()) == ["m", "m/a"]
    entries = spark.createDataFrame([("a", 5.0, 1.0), ("b", 9.0, 0.0), ("c", 9.0, 2.0)], "path string, static double, critical double")
    assert [r["path"] for r in gap.first(entries, "static", 2).collect()] == ["b", "c"] and [r["path"] for r in gap.first(entries).collect()] == ["c", "a", "b"]
