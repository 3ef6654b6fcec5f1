"""Evidence-backed risks, findings and gates, as unions of column rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from repolytics.functions.numeric import col, round2
from repolytics.functions.predicates import SEVERITIES, severity_of_impact, severity_rank
from repolytics.functions.text import many_direct

CODE, DEPENDENCY, GIT = 0.4, 0.3, 0.3
MOST_IMPACT = 15.0
LOW_TEST_RATIO = 0.15


def cap(impact) -> Column:
    """An impact held in 0..15, rounded only strictly inside."""
    x = col(impact)
    return F.when(x <= 0, 0.0).when(x >= MOST_IMPACT, MOST_IMPACT).otherwise(round2(x))


def _rule(frame: DataFrame, when, kind: str, category, subject, impact, keys: list[str], about=None) -> DataFrame:
    """keys, id, category, subject, impact: the id is the kind and, of rules for one thing, its name."""
    named = isinstance(subject, Column)
    name = F.concat(F.lit(kind), F.lit("."), subject) if named else F.lit(kind)
    shown = about if about is not None else subject if named else F.lit("")
    return frame.filter(when).select(*keys, name.alias("id"), (category if isinstance(category, Column) else F.lit(category)).alias("category"), shown.alias("subject"), cap(impact).alias("impact"))


def hotspot_risks(hotspots: DataFrame, keys: list[str] = []) -> DataFrame:
    hard = F.when(F.col("complexity") > 0, F.col("complexity") / 20).otherwise(1.0)
    impact = (3 + 2 * F.col("code_lines") / 500 + 1.5 * F.col("churn") / 30 + 2 * hard) * CODE
    return _rule(hotspots, F.col("confirmed"), "code.hotspot", "code", F.col("path"), impact, keys)


def complexity_risks(summary: DataFrame, worst: DataFrame, keys: list[str] = []) -> DataFrame:
    """summary: very_high_files, files, max_complexity_file; worst: path, complexity, level."""
    share = F.col("very_high_files") / F.greatest(F.col("files"), F.lit(1)) * 30 * CODE
    spread = _rule(summary, F.col("very_high_files") > 0, "code.complexity.distribution", "complexity", "", share, keys, about=F.col("max_complexity_file"))
    one = _rule(worst, F.col("level").isin("high", "very_high"), "code.complexity", "complexity", F.col("path"), F.col("complexity") / 20 * 8 * CODE, keys)
    return spread.unionByName(one)


def testing_risks(stats: DataFrame, keys: list[str] = []) -> DataFrame:
    none = _rule(stats, (F.col("source_files") > 0) & (F.col("test_files") == 0), "testing.none", "testing", "", F.lit(4.0), keys)
    few = (F.col("test_files") > 0) & (F.col("source_files") > 0) & (F.col("test_file_ratio") < LOW_TEST_RATIO)
    return none.unionByName(_rule(stats, few, "testing.ratio", "testing", "", (LOW_TEST_RATIO - F.col("test_file_ratio")) / LOW_TEST_RATIO * 6 * CODE, keys))


def dependency_risks(ecosystems: DataFrame, keys: list[str] = []) -> DataFrame:
    """ecosystems: name, manifest, lockfile, direct, transitive, drift, stale."""
    name, times = F.col("name"), F.try_divide(F.col("transitive").cast("double"), F.col("direct").cast("double"))
    manifest, lock = F.col("manifest"), F.col("lockfile")
    return reduce(DataFrame.unionByName, [
        _rule(ecosystems, F.col("drift"), "dependency.drift", "dependency", name, F.lit(5 * DEPENDENCY), keys, about=manifest),
        _rule(ecosystems, F.col("stale") & ~F.col("drift"), "dependency.lockfile_stale", "dependency", name, F.lit(1.0), keys, about=lock),
        _rule(ecosystems, (times >= 10) & (F.col("direct") > 5), "dependency.transitive", "dependency", name, (times - 10) / 10 * 4 * DEPENDENCY, keys, about=manifest),
    ])


def git_risks(stats: DataFrame, keys: list[str] = []) -> DataFrame:
    """stats: commits, bus_factor, top_share, concentration, top_path, days_since_commit."""
    some = F.col("commits") > 0
    return reduce(DataFrame.unionByName, [
        _rule(stats, some & (F.col("bus_factor") <= 1) & (F.col("top_share") >= 0.7), "git.bus_factor", "git", "", F.col("top_share") * 6 * GIT, keys),
        _rule(stats, some & (F.col("concentration") >= 0.6), "git.churn_concentration", "git", "", F.col("concentration") * 5 * GIT, keys, about=F.col("top_path")),
        _rule(stats, some & (F.col("days_since_commit") >= 180), "git.stale", "git", "", F.col("days_since_commit") / 180 * 4 * GIT, keys),
    ])


def dimension_risks(metrics: DataFrame, keys: list[str] = []) -> DataFrame:
    """metrics: key, score, weight, applicable."""
    short = 100 - F.col("score")
    return _rule(metrics, F.col("applicable") & (short >= 10), "score", F.col("key"), F.col("key"), short * F.col("weight"), keys, about=F.lit(""))


def assess(*families: DataFrame) -> DataFrame:
    """All risks with severity (by impact) and rank (severity, impact, id)."""
    every = reduce(DataFrame.unionByName, families)
    return every.withColumn("severity", severity_of_impact("impact"))


def ordered(risks: DataFrame) -> DataFrame:
    return risks.orderBy(F.desc(severity_rank("severity")), F.desc("impact"), "id")


def filtered(risks: DataFrame, severity: str) -> DataFrame:
    """The risks of one severity; an unknown one is refused, so that it never passes for "all"."""
    wanted = severity.strip().lower()
    if wanted not in SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}: one of {', '.join(reversed(SEVERITIES))}")
    return risks.filter(F.col("severity") == wanted)


def _findings(frame: DataFrame, category: str, rules: list[tuple], keys: list[str]) -> DataFrame:
    """keys, severity, category, title, detail, subject of the rules (when, severity, title, detail, subject) that fire."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = [F.when(when, F.struct(text(s).alias("severity"), F.lit(category).alias("category"), text(t).alias("title"), text(d).alias("detail"), text(about).alias("subject"))) for when, s, t, d, about in rules]
    return frame.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("f")).select(*keys, "f.*")


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(severity_rank("severity")), "title", "subject")


def refreshed(findings: DataFrame, code_again: DataFrame) -> DataFrame:
    """findings with those about code replaced by newer ones (after late churn)."""
    return findings.filter(~F.col("category").isin("code", "complexity", "testing")).unionByName(code_again)


def code_findings(hotspots: DataFrame, stats: DataFrame, summary: DataFrame, oversized: DataFrame | None = None, keys: list[str] = []) -> DataFrame:
    """severity, category, title, detail, subject.

    hotspots: path, confirmed, reason.  stats: files, test_files.  summary:
    very_high_files, max_complexity, max_complexity_file.  oversized: one row (for each of
    keys) with truncated (files above the size cap) and skipped (entries not read).
    """
    sure = F.col("confirmed")
    found = [
        _findings(hotspots, "code", [(F.lit(True), F.when(sure, "high").otherwise("low"), F.when(sure, "Confirmed hotspot").otherwise("Large file / hotspot candidate"), F.col("reason"), F.col("path"))], keys),
        _findings(summary, "complexity", [(F.col("very_high_files") > 0, "medium", "Very high estimated complexity", F.format_string("%d file(s) above the bound, at most %.1f in %s", "very_high_files", "max_complexity", "max_complexity_file"), "")], keys),
        _findings(stats, "testing", [((F.col("test_files") == 0) & (F.col("files") > 0), "medium", "No test files detected", F.format_string("none of %d source files is named like a test", "files"), "")], keys),
        _findings(stats, "code", [(F.col("files") == 0, "info", "No source files detected", "no file has an extension that is known", "")], keys),
    ]
    if oversized is not None:
        found.append(_findings(oversized, "code", [
            (F.col("truncated") > 0, "low", "Oversized files skipped", F.format_string("%d file(s) above the size cap are not in the counts", "truncated"), ""),
            (F.col("skipped") > 0, "info", "Unreadable entries skipped", F.format_string("%d entries could not be read", "skipped"), ""),
        ], keys))
    return reduce(DataFrame.unionByName, found)


def git_findings(stats: DataFrame, window_days: int = 90, keys: list[str] = []) -> DataFrame:
    """severity, category, title, detail, subject; a repository without commits has one finding alone.

    stats: commits, window_commits, days_since_commit, bus_factor, concentration, rate,
    paths, top_path, note (null where the data is whole).
    """
    some = F.col("commits") > 0
    return _findings(stats, "git", [
        (F.col("commits") == 0, "medium", "No commits on HEAD", "no commit can be reached", ""),
        (some & (F.col("days_since_commit") > window_days), "medium", "Stale repository", F.format_string(f"the last commit is %d days old, the window {window_days}", "days_since_commit"), ""),
        (some & (F.col("bus_factor") <= 1) & (F.col("window_commits") >= 10), "high", "Bus factor of 1", F.format_string("one author holds most of %d commits in the window", "window_commits"), ""),
        (some & (F.col("concentration") >= 0.5) & (F.col("paths") > 0), "high", "Churn concentrated in few files", F.format_string("the first three of %d changed files hold %.1f%% of the change", F.col("paths"), F.col("rate") * 100), F.col("top_path")),
        (some & F.col("note").isNotNull() & (F.col("note") != ""), "info", "Partial git data", F.col("note"), ""),
    ], keys)


def dependency_findings(ecosystems: DataFrame, keys: list[str] = []) -> DataFrame:
    """severity, category, title, detail, subject; ecosystems: name, manifest, lockfile, direct, drift, stale."""
    return _findings(ecosystems, "dependency", [
        (F.col("drift"), "high", F.concat(F.lit("Missing lockfile for "), F.col("manifest")), F.format_string("%s declares %d direct dependencies and no lockfile pins them", "manifest", "direct"), F.col("manifest")),
        (F.col("stale"), "low", "Lockfile older than manifest", F.format_string("%s changed after %s", "manifest", "lockfile"), F.col("lockfile")),
        (F.col("direct") > many_direct("name"), "medium", "Large direct dependency surface", F.format_string("%d direct %s dependencies", "direct", "name"), F.col("manifest")),
    ], keys)


def _breach(when, rule: str, actual, bound) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), actual.cast("double").alias("actual"), F.lit(bound).cast("double").alias("bound")))


def breaches(snapshots: DataFrame, thresholds: dict[str, float | bool | None], keys: list[str]) -> DataFrame:
    """keys, rule, actual, bound of every threshold that a snapshot breaks, in the order of rules.

    thresholds: min_health_score, max_health_drop, max_complexity_increase,
    max_risk_count, max_hotspots (None is unset, 0 a real bound), fail_on_drift and
    require_tests (true or false).  Other names min_<column> and max_<column> bound that
    column.  snapshots: the columns the set thresholds need out of score, avg_complexity,
    risk_count, confirmed_hotspots, dependency_drift, source_files, test_files, and of the
    snapshot before it previous_score and previous_complexity (null: there is none; a drop
    then breaks nothing, and an increase is measured from zero).
    """
    rules = []
    for name, bound in thresholds.items():
        if bound is None or bound is False:
            continue
        if name == "min_health_score":
            rules.append(_breach(F.col("score") < bound, name, F.col("score"), bound))
        elif name == "max_health_drop":
            drop = F.col("previous_score") - F.col("score")
            rules.append(_breach(F.coalesce(drop > bound, F.lit(False)), name, drop, bound))
        elif name == "max_complexity_increase":
            rise = F.col("avg_complexity") - F.coalesce("previous_complexity", F.lit(0.0))
            rules.append(_breach(rise > bound, name, rise, bound))
        elif name == "max_hotspots":
            rules.append(_breach(F.col("confirmed_hotspots") > bound, name, F.col("confirmed_hotspots"), bound))
        elif name == "fail_on_drift":
            rules.append(_breach(F.coalesce("dependency_drift", F.lit(False)), name, F.lit(1), 1))
        elif name == "require_tests":
            rules.append(_breach((F.col("source_files") > 0) & (F.col("test_files") == 0), name, F.lit(0), 1))
        else:
            side, column = name.split("_", 1)
            actual = F.col(column)
            rules.append(_breach(actual < bound if side == "min" else actual > bound, name, actual, bound))
    if not rules:
        rules = [F.lit(None).cast("struct<rule:string,actual:double,bound:double>")]
    found = F.array_sort(F.array_compact(F.array(*rules)))  # by rule, its first field
    return snapshots.select(*keys, F.explode(found).alias("b")).select(*keys, "b.*")


def ci_breaches(snapshots: DataFrame, risks: DataFrame, fail_under: float | None = None, test_ratio_drop: float | None = None, critical: bool = False, keys: list[str] = []) -> DataFrame:
    """keys, rule, actual, bound, subject of the gates of a build.

    snapshots: score, test_file_ratio, previous_test_ratio (null: no baseline, so nothing
    has dropped).  risks: keys, id, impact, severity; each critical one breaks the build.
    """
    drop = (F.col("previous_test_ratio") - F.col("test_file_ratio")) * 100
    rules = [F.lit(None).cast("struct<rule:string,actual:double,bound:double>")]
    if fail_under is not None:
        rules.append(_breach(F.col("score") < fail_under, "fail_under_health", F.col("score"), fail_under))
    if test_ratio_drop is not None:
        rules.append(_breach(F.coalesce(drop > test_ratio_drop, F.lit(False)), "fail_on_test_ratio_drop", round2(drop), test_ratio_drop))
    out = snapshots.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("b")).select(*keys, "b.*", F.lit("").alias("subject"))
    if critical:
        hit = risks.filter(F.col("severity") == "critical")
        out = out.unionByName(hit.select(*keys, F.lit("fail_on_critical_risk").alias("rule"), F.col("impact").cast("double").alias("actual"), F.lit(0.0).alias("bound"), F.col("id").alias("subject")))
    return out


def workflow_breaches(findings: DataFrame, least: str) -> DataFrame:
    """rule, place, detail of workflow findings of at least this severity; "none" breaks nothing.

    An unknown severity is refused, so that it never passes for "none".
    """
    wanted = least.strip().lower()
    if wanted in ("none", "off"):
        return findings.limit(0).select(F.lit("").alias("rule"), F.lit("").alias("place"), "detail")
    if wanted not in SEVERITIES[1:]:
        raise ValueError(f"unknown severity {least!r}")
    place = F.when(F.coalesce("job", F.lit("")) == "", F.col("file")).otherwise(F.concat("file", F.lit(" job "), "job"))
    return findings.filter(severity_rank("severity") >= SEVERITIES.index(wanted)).select(F.concat(F.lit("workflow_"), "rule").alias("rule"), place.alias("place"), "detail")
