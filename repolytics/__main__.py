"""Command line: python -m repolytics COMMAND [PATH] [options].

Every command reads a repository (or a history of snapshots) through Spark and prints a
table, Markdown or JSON.  `ci` exits with 1 where a gate is broken.
"""

from __future__ import annotations

import argparse
import datetime
import os
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from repolytics import api, server, settings, storage
from repolytics.operators import ci, cognitive, gap, workspace
from repolytics.plans import health, history, reports, risks, setup
from repolytics.session import build_session, ship
from repolytics.sources import capture, facts, profiles, snapshots, workflows

VERSION = "2"
LIMIT = 50
GATES = ("min_health_score", "max_health_drop", "max_complexity_increase", "max_risk_count", "max_hotspots", "fail_on_drift", "require_tests")
HEADS = "commit string, author string, email string, at timestamp, merge boolean"
COMMITS = "commit string, author string, email string, at timestamp, path string, added bigint, deleted bigint"


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")


def options(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="repolytics", description="Repository health on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("path", nargs="?", default=".")
    common.add_argument("--format", choices=("table", "markdown", "json"), default="table")
    common.add_argument("--only", nargs="*", help="sections to show")
    common.add_argument("--master", default=os.environ.get("SPARK_MASTER") or "local[*]")
    common.add_argument("--since", help="oldest commit date")
    common.add_argument("--history", help="folder of stored snapshots")
    add = lambda name, **more: commands.add_parser(name, parents=[common], **more)
    add("analyze", aliases=["an"], help="everything measured")
    add("status", aliases=["st"], help="the score and the first risks")
    own = add("history", aliases=["log"], help="stored snapshots over time")
    own.add_argument("--limit", type=int)
    own = add("watch", aliases=["w"], help="analyse again when files change")
    own.add_argument("--interval", type=float, default=2.0)
    own.add_argument("--rounds", type=int, default=0, help="stop after so many rounds; 0: never")
    own = add("compare", aliases=["diff"], help="two revisions")
    own.add_argument("--base", required=True)
    own.add_argument("--head", default="HEAD")
    add("topology", help="boundaries, ownership, coupling")
    own = add("blast", help="what a change is likely to touch")
    own.add_argument("--files", nargs="*")
    add("decay", help="paths that fade")
    add("cognitive", help="load of functions")
    own = add("gap", help="static effort against a runtime profile")
    own.add_argument("--profile", required=True)
    own = add("ci", help="gates, workflow rules and a comment")
    for gate in ("min-health-score", "max-health-drop", "max-complexity-increase", "max-risk-count", "max-hotspots", "fail-on-test-ratio-drop"):
        own.add_argument(f"--{gate}", type=float)
    for gate in ("fail-on-drift", "require-tests", "fail-on-critical-risk", "no-gate"):
        own.add_argument(f"--{gate}", action="store_true")
    own.add_argument("--workflow-severity", default="none")
    own.add_argument("--baseline", help="a snapshot as JSON")
    own.add_argument("--event", help="the event's JSON")
    own.add_argument("--comment", help="where to write the comment")
    own = add("serve", aliases=["ui"], help="the figures over HTTP")
    own.add_argument("--port", type=int, default=8080)
    add("setup", help="settings proposed for the repository")
    own = add("explain", help="facts for a summary, and a check of one")
    own.add_argument("--summary", help="a written summary whose numbers are checked")
    commands.add_parser("version", help="the version")
    return parser.parse_args(argv)


def history_of(spark: SparkSession, root: str, work: str, since: str | None) -> tuple[DataFrame, DataFrame]:
    """Changed files and commits (merges included) of a repository, read from a log in the shared folder."""
    path = capture.log(root, work, since, merges=True)
    if not os.path.getsize(path):
        return spark.createDataFrame([], COMMITS), spark.createDataFrame([], HEADS)
    records = spark.read.text(storage.published(spark, path, "log"), lineSep="\x1e")
    heads = facts.log_heads(records)
    return facts.log_records(records).join(heads.filter("not merge").select("commit"), "commit", "left_semi"), heads


def commits(spark: SparkSession, root: str, work: str, since: str | None) -> DataFrame:
    return history_of(spark, root, work, since)[0]


def analysis(spark: SparkSession, root: str, work: str, since: str | None = None, own: dict | None = None) -> dict[str, DataFrame]:
    own = own or settings.load(root)[0]
    ignored = facts.IGNORED_DIRS if own["ignore_dirs"] is None else tuple(own["ignore_dirs"])
    ecosystems = facts.dependency_stats(facts.manifest_files(spark, root)).filter("dir = ''")
    files, heads = history_of(spark, root, work, since)
    sources, gaps = (read(spark, root, own["max_file_bytes"], ignored) for read in (facts.source_files, facts.scan_gaps))
    return api.analyze(sources, files, ecosystems, now(), gaps, heads, own["git_window_days"])


def stored(spark: SparkSession, folder: str | None) -> DataFrame | None:
    try:
        return snapshots.history(spark, folder) if folder else None
    except Exception as error:
        if not facts.absent_path(error):
            raise
        return None


def gated(spark: SparkSession, found: dict[str, DataFrame], args: argparse.Namespace, root: str) -> tuple[str, int]:
    """The evidence first, then the verdict: a broken gate still leaves its report."""
    own = api.snapshot(found, root, now(), capture.head(root), VERSION)
    before = snapshots.read(spark, args.baseline).limit(1) if args.baseline else spark.createDataFrame([(None,)], "x int").select(*[F.lit(None).cast("double").alias(c) for c in ("score", "avg_complexity", "test_file_ratio", "code_score", "dependency_score", "git_score")])
    names = {"score": "previous_score", "avg_complexity": "previous_complexity", "test_file_ratio": "previous_test_ratio"}
    one = own.crossJoin(F.broadcast(before.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("test_file_ratio").alias("previous_test_file_ratio"), *[F.col(f"{k}_score").alias(f"previous_{k}_score") for k in ("code", "dependency", "git")])))
    event = None
    if args.event and os.path.exists(args.event):
        with open(args.event) as file:
            event = spark.createDataFrame([(file.read(),)], "t string").select(facts.pull_request_event("t").alias("e")).select("e.*").first().asDict()
    if args.comment:
        with open(args.comment, "w") as file:
            file.write(reports.comment(one, found["risks"], (event or {}) | {"baseline": args.baseline}, version=VERSION))
    flows = ci.findings(workflows.workflows(workflows.workflow_files(spark, root)))
    out = [reports.sections({"categories": health.categories(one, []), "workflows": ci.ordered(flows)}, args.format)]
    if args.no_gate:
        return "".join(out), 0
    own = settings.load(root, **{k: getattr(args, k) or None if k in ("fail_on_drift", "require_tests") else getattr(args, k) for k in GATES})[0]
    limits = {k: own[k] for k in GATES}
    broken = [risks.breaches(one, limits, []), risks.ci_breaches(one, found["risks"], None, args.fail_on_test_ratio_drop, args.fail_on_critical_risk), risks.workflow_breaches(flows, args.workflow_severity)]
    shown = {name: frame for name, frame in zip(("gates", "build", "workflow gates"), broken) if frame.limit(1).count()}
    return "".join([*out, reports.sections(shown, args.format)]), 1 if shown else 0


def watched(spark: SparkSession, args: argparse.Namespace, root: str, work: str) -> None:
    """Analyse again whenever the newest file changes; says what moved."""
    from repolytics.streaming import watch

    last = None
    for _, changed in zip(range(args.rounds or sys.maxsize), watch.polled(root, args.interval)):
        found = analysis(spark, root, work, args.since)
        own = api.snapshot(found, root, now()).withColumn("id", F.lit(1 if last is None else 2).cast("bigint"))
        row = spark.createDataFrame(own.collect(), own.schema)
        both = row if last is None else last.withColumn("id", F.lit(1).cast("bigint")).unionByName(row)
        said = spark.createDataFrame([(changed,)], "p array<string>").select(history.changed_line(F.col("p"))).first()[0]
        print(said, history.movement(both).orderBy(F.desc("id")).first()["line"], flush=True)
        last = row
        found["records"].unpersist()


def run(args: argparse.Namespace) -> int:
    if args.command == "version":
        print(VERSION)
        return 0
    spark = build_session(args.master, "repolytics", **{"spark.ui.enabled": "false"})
    ship(spark)
    root, work = os.path.abspath(args.path), tempfile.mkdtemp(prefix="repolytics-")
    configured, warnings = settings.load(root)
    settings.check(configured)
    for warning in warnings:
        print(warning, file=sys.stderr)
    show = lambda frames: print(reports.sections(frames, args.format, args.only), end="")
    command = {"an": "analyze", "st": "status", "log": "history", "w": "watch", "diff": "compare", "ui": "serve"}.get(args.command, args.command)
    if command == "history":
        own = stored(spark, args.history)
        if own is None:
            print("no history")
            return 0
        page = history.page(own, root, args.limit or configured["history_limit"])
        show({"history": history.trend(page).orderBy("id"), "summary": history.summary(page)})
        if args.format != "json":
            print(reports.timeline(history.trend(page)))
        return 0
    if command in ("topology", "blast", "decay"):
        log = commits(spark, root, work, args.since)
        if command == "decay":
            show(api.decayed(log, now(), LIMIT))
        elif command == "blast":
            changed = spark.createDataFrame([(f,) for f in args.files], "path string") if args.files else facts.pending_changes(*(spark.read.text(storage.published(spark, p, "pending")) for p in capture.pending(root, work)))
            show({"predictions": api.blast(log, changed)})
        else:
            files = facts.source_files(spark, root).filter("language = 'Go'")
            module = facts.module_of(spark, root)
            show(api.topology(log, facts.go_imports(files, module), facts.go_packages(files, module), now(), module, limit=LIMIT))
        return 0
    if command == "cognitive":
        sources = facts.source_files(spark, root)
        each, per = cognitive.measured(sources), cognitive.functions(sources.filter("language = 'Go'"))
        show({"summary": cognitive.summary(each), "files": each.orderBy(F.desc("score"), "path"), "functions": per.orderBy(F.desc("density"), "path", "line")})
        return 0
    if command == "compare":
        sides = [analysis(spark, capture.revision(root, ref, work), work) for ref in (args.base, args.head)]
        show(api.compare(*sides))
        return 0
    if command == "watch":
        watched(spark, args, root, work)
        return 0
    found = analysis(spark, root, work, args.since)
    if command == "status":
        print(reports.status(found["total"], found["risks"]), end="")
    elif command == "gap":
        samples = profiles.load(spark.read.format("binaryFile").load(args.profile).select("path", "content"))
        own = profiles.summary(samples.filter("error is null"))
        coverage = own.agg(F.coalesce(F.max("coverage"), F.lit(0.0))).first()[0]
        seen = samples.filter("file is not null").groupBy("file").agg(F.sum("hits").alias("hits"), F.sum("latency_ns").alias("latency_ns"))
        show({"profile": own, "entries": gap.first(gap.entries(found["records"], seen, coverage, found["churn"].select("path", "added", "deleted")), "critical" if coverage > 0 else "static", LIMIT)})
    elif command == "ci":
        text, code = gated(spark, found, args, root)
        print(text, end="")
        return code
    elif command == "setup":
        first = commits(spark, root, work, None).agg(F.min("at").alias("first_commit"))
        folders = spark.createDataFrame([(root, d) for d in os.listdir(root) if os.path.isdir(os.path.join(root, d))] or [(root, "")], "root string, name string")
        marks = facts.text_files(spark, root, ("pnpm-workspace.yaml", "lerna.json", "go.work", "Cargo.toml", "package.json", "go.mod", "pyproject.toml"))
        packages = workspace.detect(marks.select(F.lit(root).alias("root"), "path", "text")).agg(F.count(F.lit(1)).alias("packages"))
        print(setup.rendered(setup.propose(first.crossJoin(packages).withColumns({"root": F.lit(root), "took_ms": F.lit(0).cast("bigint")}), folders, now())), end="")
    elif command == "explain":
        text, known = reports.facts(api.measures(found), found["risks"])
        print(text)
        if args.summary:
            wrong = reports.summary_checked(spark, args.summary, known)
            print("numbers without a fact: " + ", ".join(wrong) if wrong else "every number has a fact")
            return 1 if wrong else 0
    elif command == "serve":
        server.serve(found, api.snapshot(found, root, now(), capture.head(root), VERSION), stored(spark, args.history), args.port, VERSION)
    else:
        if args.history:
            snapshots.append(api.snapshot(found, root, now(), capture.head(root), VERSION), args.history)
            history.pruned(spark, args.history)
        wanted = ("total", "metrics", "stats", "languages", "hotspots", "churn", "git", "ecosystems", "risks", "findings")
        show({k: found[k] for k in wanted})
    return 0


if __name__ == "__main__":
    sys.exit(run(options()))
