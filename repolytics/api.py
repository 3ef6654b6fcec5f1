"""Entry points: what a user calls with fact tables in hand.

Each returns DataFrames; only what iterates (cycles, predictions) starts jobs of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from repolytics.functions.numeric import round2
from repolytics.functions.predicates import boundary_of
from repolytics.operators import boundaries, churn, code, coupling, decay, evidence, gap, ownership, workspace
from repolytics.plans import health, history, risks

WINDOW_DAYS = 90


def git_measures(commit_files: DataFrame, commits: DataFrame, now, window_days: int = WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """Churn by path, and one row of what the history shows.

    Churn, its concentration, the hotspot rate and the bus factor are of the window's
    commits without merges; all commits, authors and the top author's share are of the
    whole history, merges included; commits in the window include merges.  commits: commit,
    at, author, merge.  commit_files of merges do not count.
    """
    start = F.lit(now).cast("timestamp") - F.expr(f"interval {window_days} days")
    plain = commits.filter(~F.col("merge")).select("commit")
    recent = commit_files.filter(F.col("at") >= start).join(plain, "commit", "left_semi")
    changed = churn.churn_by_path(recent)
    authors = churn.author_counts(commits)
    busy = churn.author_counts(commits.filter(~F.col("merge") & (F.col("at") >= start)))
    top = churn.top_churn(changed, 1).agg(F.max("path").alias("top_path"))
    people = churn.top_share(authors).crossJoin(F.broadcast(authors.agg(F.count(F.lit(1)).alias("authors")))).select("top_share", "authors")
    lines = changed.agg(F.coalesce(F.sum("added"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("lines_deleted"))
    parts = [churn.cadence(commits, now, window_days), churn.concentration(changed).select("paths", "concentration"), churn.hotspot_rate(changed).select("rate"), churn.bus_factor(busy), people, lines, top]
    return changed, reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def analyze(files: DataFrame, commit_files: DataFrame, ecosystems: DataFrame, now, gaps: DataFrame | None = None, commits: DataFrame | None = None, window_days: int = WINDOW_DAYS) -> dict[str, DataFrame]:
    """Everything measured of one repository, as frames by name.

    files: path, language, content.  commit_files: commit, at, author, path, added,
    deleted.  ecosystems: name, manifest, lockfile, direct, transitive, drift, stale.
    gaps: one row with truncated and skipped.  commits: commit, at, author, merge of all
    commits; without it those of commit_files, none a merge.  The file records, which most
    frames are made of, are cached; records.unpersist() gives them up.
    """
    records = code.measure(files).persist()
    if commits is None:
        commits = commit_files.groupBy("commit").agg(F.min("at").alias("at"), F.min("author").alias("author")).withColumn("merge", F.lit(False))
    changed, git = git_measures(commit_files, commits, now, window_days)
    git = git.withColumn("note", F.lit(None).cast("string"))
    stats, summary = code.code_stats(records), code.complexity_summary(records)
    hot = code.hotspots(records, changed)
    deps = ecosystems.agg(F.coalesce(F.sum("direct"), F.lit(0)).alias("direct"), F.coalesce(F.sum("transitive"), F.lit(0)).alias("transitive"), F.coalesce(F.bool_or("drift"), F.lit(False)).alias("dependency_drift"), F.count(F.lit(1)).alias("ecosystems"))
    heat = hot.agg(F.count(F.lit(1)).alias("hotspots"), F.count_if("confirmed").alias("confirmed_hotspots"), F.coalesce(F.sum("code_lines"), F.lit(0)).alias("hotspot_lines"))
    one = stats.crossJoin(F.broadcast(heat)).crossJoin(F.broadcast(git)).crossJoin(F.broadcast(deps))
    scored = one.select(
        F.lit("").alias("root"), F.when(F.col("files") > 0, health.code_score("avg_file_lines", "hotspot_lines", "code_lines", "files", F.least("languages", F.lit(8)))).alias("code_score"),
        health.dependency_score("direct", ~F.col("dependency_drift"), "ecosystems").alias("dependency_score"),
        F.when(F.col("commits") > 0, health.git_score("commits", "commits_per_week", "span_days", "days_since_commit", "concentration", "bus_factor")).alias("git_score"),
    )
    metrics = health.metrics(scored, ["root"])
    total = health.total(metrics, ["root"])
    worst = code.worst_files(records)
    found = risks.assess(
        risks.hotspot_risks(hot), risks.complexity_risks(summary, worst.limit(1)), risks.testing_risks(stats), risks.dependency_risks(ecosystems), risks.git_risks(git), risks.dimension_risks(metrics)
    )
    findings = risks.code_findings(hot, stats, summary, gaps).unionByName(risks.git_findings(git)).unionByName(risks.dependency_findings(ecosystems))
    return {
        "total": total, "metrics": metrics, "stats": stats, "summary": summary, "languages": code.languages(records), "worst": worst, "hotspots": hot, "churn": churn.top_churn(changed), "git": git, "dependencies": deps,
        "ecosystems": ecosystems, "risks": risks.ordered(found), "findings": risks.ordered_findings(findings), "records": records, "scores": scored,
    }


def snapshot(found: dict[str, DataFrame], root: str, recorded_at, commit: str = "", version: str = "") -> DataFrame:
    """One row of sources.snapshots.SCHEMA from what analyze() gives."""
    every = found["risks"].agg(F.count(F.lit(1)).alias("risk_count"), F.count_if(F.col("severity") == "critical").alias("critical_risk_count"), F.count_if(F.col("severity") == "high").alias("high_risk_count"))
    heat = found["hotspots"].agg(F.count(F.lit(1)).alias("hotspot_count"), F.count_if("confirmed").alias("confirmed_hotspots"))
    summary = found["summary"].select("avg_complexity", "max_complexity")
    parts = [found["total"].select("score", "grade"), found["scores"].drop("root"), every, heat, found["stats"].select("files", "source_files", "test_files", "test_file_ratio", "code_lines", "avg_file_lines"), summary, found["dependencies"].select("dependency_drift")]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    return one.select(F.lit("1").alias("schema_version"), F.lit(root).alias("root"), F.lit(recorded_at).cast("timestamp").alias("recorded_at"), F.lit(commit).alias("git_commit"), F.lit(version).alias("version"), "*")


def topology(commit_files: DataFrame, imports: DataFrame, packages: DataFrame, now, module: str = "", min_commits: int = evidence.LEAST_COMMITS, threshold: float = 0.6, limit: int | None = None, graph: bool = True) -> dict[str, DataFrame]:
    """Boundaries, violations, cycles, ownership, bus factors, coupling and hidden coupling.

    packages: package (with the module in front), boundary.  Without a module there is no
    import graph, and nothing is hidden.  Coupling has no rows below min_commits commits and
    at_risk is null below 30 days of history; gates says what was withheld and why.  Cycles
    are searched at once; without graph neither they nor boundaries and violations are there.
    """
    commits = commit_files.groupBy("commit").agg(F.min("at").alias("at"))
    known = evidence.history(commits, now)
    owned = ownership.owners(commit_files, "path", now)
    enough, _ = evidence.enough_commits(min_commits)
    judged, why = evidence.enough_ownership()
    pairs = coupling.pairs(commit_files, threshold=threshold).crossJoin(F.broadcast(known.select(enough.alias("enough")))).filter("enough").drop("enough")
    pairs = pairs.withColumn("same_boundary", boundary_of("a") == boundary_of("b"))
    paths = workspace.package_of(commit_files.select("path").distinct(), packages.select("package").distinct(), module)
    related = coupling.related(pairs, paths, imports)
    concealed = related.filter("not imports" if module else "false")
    risk = evidence.with_gate(ownership.risk(owned, now).crossJoin(F.broadcast(known)), judged, why, "at_risk").drop("commits", "first_at", "history_days")
    found = {}
    if graph:
        cycles = boundaries.cycles(imports, packages)
        violations = boundaries.violations(imports, packages, module).unionByName(boundaries.cycle_violations(cycles, packages))
        found = {"boundaries": boundaries.dependencies(imports, packages), "violations": violations, "cycles": cycles}
    return found | {
        "ownership": owned, "units": ownership.units(commit_files, now),
        "bus_factor": ownership.bus_factor(owned), "risk": risk, "coupling": coupling.strongest(related, limit), "hidden": coupling.strongest(concealed, limit), "gates": evidence.gates(known),
    }


def blast(commit_files: DataFrame, changeset: DataFrame, min_commits: int = evidence.LEAST_COMMITS) -> DataFrame:
    """What a changeset is likely to touch; nothing where the history is too short to say."""
    if commit_files.select("commit").distinct().limit(min_commits).count() < min_commits:
        return coupling.expand(coupling.pairs(commit_files.limit(0)), changeset)
    return coupling.expand(coupling.pairs(commit_files, threshold=0.5), changeset)


def decayed(commit_files: DataFrame, now, limit: int | None = None) -> dict[str, DataFrame]:
    commits = commit_files.groupBy("commit").agg(F.min("at").alias("at"))
    return {"orphans": decay.orphans(commit_files, now, limit=limit), "silos": decay.silos(commit_files, limit=limit), "half_life": decay.half_life(commits, now)}


def runtime_gap(records: DataFrame, runtime: DataFrame, coverage: float, churned: DataFrame | None = None) -> DataFrame:
    return gap.entries(records, runtime, coverage, churned)


def measures(found: dict[str, DataFrame]) -> DataFrame:
    """One row of the measures by which revisions are compared, from what analyze() gives."""
    heat = found["hotspots"].agg(F.count(F.lit(1)).alias("hotspots"), F.count_if("confirmed").alias("confirmed_hotspots"))
    git = found["git"].select("window_commits", "bus_factor", "concentration", "authors")
    parts = [found["total"].select("score", "grade"), found["stats"].select("code_lines", "total_lines", "source_files", "test_files", "test_file_ratio", "avg_file_lines"), heat, found["summary"].select("max_complexity", "avg_complexity", "max_nesting"), found["dependencies"].select("direct", "transitive", (F.col("direct") + F.col("transitive")).alias("total_dependencies")), git]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def compare(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What changed between two analyses: verdict, metrics that moved, risks added, resolved and changed."""
    one, two = measures(a), measures(b)
    both = one.select(F.col("score").alias("before"), F.col("grade").alias("grade_before")).crossJoin(F.broadcast(two.select(F.col("score").alias("after"), F.col("grade").alias("grade_after"))))
    said = both.withColumn("delta", round2(F.col("after") - F.col("before"))).withColumn("verdict", history.verdict("delta"))
    return {"verdict": said, "metrics": history.metric_deltas(one, two), "risks": history.risk_changes(a["risks"], b["risks"])}
