"""Snapshots over time: append, prune, trend, comparison of two revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from repolytics import storage
from repolytics.functions.numeric import round2
from repolytics.functions.text import bracketed, delta_line

MOVED = 0.05


def prune(records: DataFrame, keep: int = 500) -> DataFrame:
    """The newest records of each root."""
    newest = Window.partitionBy("root").orderBy(F.desc("id"))
    return records.withColumn("age_rank", F.row_number().over(newest)).filter(F.col("age_rank") <= keep).drop("age_rank")


def pruned(spark, path: str, keep: int = 500) -> int:
    """Keep the newest records of each root in a history table; how many went.

    What is kept of roots with more is first written to the shared folder, then back to
    their partitions by the writer's commit, both by the executors, so a failed write loses
    nothing.
    """
    records = spark.read.parquet(path)
    over = records.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > keep)
    gone = over.agg(F.coalesce(F.sum(F.col("n") - keep), F.lit(0))).first()[0]
    if gone:
        beside = storage.new_folder(spark, "kept")
        prune(records.join(over.select("root"), "root", "left_semi"), keep).write.parquet(beside)
        spark.read.schema(records.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root").parquet(path)
        storage.remove(spark, beside)
    return gone


def latest(records: DataFrame) -> DataFrame:
    columns = [c for c in records.columns if c != "root"]
    return records.groupBy("root").agg(F.max_by(F.struct(*columns), "id").alias("r")).select("root", "r.*")


def page(records: DataFrame, root: str | None = None, limit: int = 60) -> DataFrame:
    """The newest limit records, oldest first."""
    own = records if root is None else records.filter(F.col("root") == root)
    return own.orderBy(F.desc("id"), "root").limit(limit).orderBy("id", "root")


def glyph(delta) -> Column:
    return F.when(delta.isNull(), "●").when(delta > MOVED, "▲").when(delta < -MOVED, "▼").otherwise("▬")


def trend(records: DataFrame, score: str = "score", risks: str = "risk_count") -> DataFrame:
    """root, id, score, delta, risk_delta, glyph against the record before."""
    before = Window.partitionBy("root").orderBy("id")
    delta = round2(F.col(score) - F.lag(score).over(before))
    own = records.withColumn("delta", delta).withColumn("risk_delta", (F.col(risks) - F.lag(risks).over(before)).cast("bigint"))
    return own.select("root", "id", F.col(score).alias("score"), "delta", "risk_delta", glyph(F.col("delta")).alias("glyph"))


def score_delta(records: DataFrame, score: str = "score") -> DataFrame:
    """root, current, previous, delta, trend of the last two records."""
    newest = Window.partitionBy("root").orderBy(F.desc("id"))
    last = records.withColumn("n", F.row_number().over(newest)).filter("n <= 2").groupBy("root").agg(F.max(F.when(F.col("n") == 1, F.col(score))).alias("current"), F.max(F.when(F.col("n") == 2, F.col(score))).alias("previous"))
    delta = round2(F.col("current") - F.col("previous"))
    moved = F.when(delta > MOVED, "improving").when(delta < -MOVED, "declining").otherwise("flat")
    return last.select("root", "current", "previous", delta.alias("delta"), moved.alias("trend"))


def summary(records: DataFrame, score: str = "score") -> DataFrame:
    """root, records, first, latest, best, worst, average, change."""
    sums = records.groupBy("root").agg(F.count(F.lit(1)).alias("records"), F.min_by(score, "id").alias("first"), F.max_by(score, "id").alias("latest"), F.max(score).alias("best"), F.min(score).alias("worst"), round2(F.avg(score)).alias("average"))
    return sums.withColumn("change", round2(F.col("latest") - F.col("first")))


#: What two revisions are compared by: label, unit, digits, and whether more
#: is better (1), worse (-1) or neither (0: volumes are reported, not judged).
MEASURES = {
    "score": ("Health score", "", 1, 1), "code_lines": ("Code lines", "LOC", 0, 0), "total_lines": ("Total lines", "LOC", 0, 0), "source_files": ("Source files", "", 0, 0), "test_files": ("Test files", "", 0, 1),
    "test_file_ratio": ("Test file ratio", "", 2, 1), "avg_file_lines": ("Avg LOC per file", "LOC", 1, -1), "hotspots": ("Hotspots", "", 0, -1), "confirmed_hotspots": ("Confirmed hotspots", "", 0, -1),
    "max_complexity": ("Max complexity", "", 1, -1), "avg_complexity": ("Avg complexity", "", 1, -1), "max_nesting": ("Max nesting", "levels", 0, -1), "direct": ("Direct deps", "", 0, -1),
    "total_dependencies": ("Total deps", "", 0, -1), "transitive": ("Transitive deps", "", 0, -1), "window_commits": ("Commits (window)", "", 0, 0), "authors": ("Authors", "", 0, 1), "bus_factor": ("Bus factor", "", 0, 1),
    "concentration": ("Churn concentration", "", 2, -1),
}


def metric_deltas(a: DataFrame, b: DataFrame, measures: dict[str, tuple] = MEASURES) -> DataFrame:
    """label, before, after, delta, better (1, -1 or 0), display of the measures that moved, most moved first.

    a, b: one row with the columns that measures names; a column that is missing or null
    on either side is not compared.
    """
    kept = {m: v for m, v in measures.items() if m in a.columns and m in b.columns}
    rows = lambda side: F.array(*[F.col(m).cast("double").alias(m) for m in kept]).alias(side)
    known = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(unit).alias("unit"), F.lit(digits).alias("digits"), F.lit(way).alias("way")) for label, unit, digits, way in kept.values()])
    both = a.select(rows("a")).crossJoin(b.select(rows("b"))).select(F.explode(F.arrays_zip("a", "b", known.alias("m"))).alias("r")).select("r.m.*", F.col("r.a").alias("before"), F.col("r.b").alias("after"))
    moved = both.withColumn("delta", round2(F.col("after") - F.col("before"))).filter("delta <> 0")
    better = (F.col("way") * F.signum("delta")).cast("bigint")
    shown = delta_line("label", "before", "after", "delta", "unit", "digits")
    return moved.select("label", "before", "after", "delta", better.alias("better"), shown.alias("display")).orderBy(F.desc(F.abs("delta")), "label")


def risk_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, change (added, resolved, changed), impacts and severities on both sides."""
    left = a.select(F.col("id").alias("id_a"), F.col("impact").alias("impact_before"), F.col("severity").alias("severity_before"))
    right = b.select(F.col("id").alias("id_b"), F.col("impact").alias("impact_after"), F.col("severity").alias("severity_after"))
    both = left.join(right, F.col("id_a") == F.col("id_b"), "full")
    kind = F.when(F.col("id_a").isNull(), "added").when(F.col("id_b").isNull(), "resolved").otherwise("changed")
    moved = F.col("id_a").isNull() | F.col("id_b").isNull() | (F.col("impact_before") != F.col("impact_after")) | (F.col("severity_before") != F.col("severity_after"))
    better = F.when(kind == "added", -1).when(kind == "resolved", 1).when(F.col("impact_after") < F.col("impact_before"), 1).otherwise(-1).cast("bigint")
    return both.filter(moved).select(F.coalesce("id_a", "id_b").alias("id"), kind.alias("change"), "impact_before", "impact_after", "severity_before", "severity_after", better.alias("better"))


def verdict(delta) -> Column:
    """The direction of a comparison, by five points of health."""
    d = F.col(delta)
    return F.when(d > 5, "significant improvement").when(d > 0, "slight improvement").when(d <= -5, "significant regression").when(d < 0, "slight regression").otherwise("no net change")


def with_previous(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """records with columns of the record before it in its root (new name -> column)."""
    before = Window.partitionBy("root").orderBy("id")
    return records.withColumns({name: F.lag(column).over(before) for name, column in columns.items()})


def movement(records: DataFrame) -> DataFrame:
    """root, id, note, line: what moved since the snapshot before, and a one-line status.

    records: root, id, score, avg_complexity, avg_file_lines, confirmed_hotspots,
    source_files, test_files, risk_count, dependency_drift.  note is null for a root's
    first snapshot, which has nothing to move from.
    """
    columns = ["score", "avg_complexity", "avg_file_lines", "confirmed_hotspots", "source_files", "test_files", "risk_count", "dependency_drift"]
    own = with_previous(records, {f"last_{c}": c for c in columns} | {"last_id": "id"})
    moved = lambda c: F.col(c) - F.col(f"last_{c}")
    complexity, size, hot, files, risks = map(moved, ("avg_complexity", "avg_file_lines", "confirmed_hotspots", "source_files", "risk_count"))
    drift, before = F.col("dependency_drift"), F.col("last_dependency_drift")
    notes = F.array(
        F.when(complexity > MOVED, "⚠ Complexity increased").when(complexity < -MOVED, "✓ Complexity decreased"),
        F.when(size > 5, F.format_string("⚠ Avg file size +%.0f LOC", size)),
        F.when(hot > 0, F.format_string("⚠ %d new confirmed hotspot(s)", hot)).when(hot < 0, F.format_string("✓ %d hotspot(s) resolved", -hot)),
        F.when((files > 0) & (moved("test_files") == 0), F.format_string("⚠ %d new file(s) with no tests", files)),
        F.when(risks > 0, F.format_string("⚠ %d new risk(s)", risks)),
        F.when(drift & ~before, "⚠ Dependency drift introduced").when(~drift & before, "✓ Dependency drift resolved"),
    )
    note = F.when(F.col("last_id").isNotNull(), F.coalesce(bracketed(notes), F.lit("no notable change")))
    line = F.when(F.col("last_id").isNull(), F.format_string("Health: %.1f", "score")).otherwise(F.concat(F.format_string("Health: %.1f -> %.1f (%+.1f) (", F.col("last_score"), F.col("score"), F.col("score") - F.col("last_score")), note, F.lit(")")))
    return own.select("root", "id", note.alias("note"), line.alias("line"))


def changed_line(paths) -> Column:
    """What a batch of changed paths is announced by."""
    n = F.size(paths)
    return F.when(n == 0, "Re-analyzing...").when(n == 1, F.concat(F.lit("Detected change in "), F.get(paths, F.lit(0)), F.lit(" -> Re-analyzing..."))).otherwise(F.concat(F.lit("Detected "), n.cast("string"), F.lit(" file changes ("), F.array_join(F.slice(paths, 1, 3), ", "), F.when(n > 3, F.concat(F.lit(", +"), (n - 3).cast("string"), F.lit(" more"))).otherwise(""), F.lit(") -> Re-analyzing...")))


def frame_delta(records: DataFrame, root: str, limit: int = 60, most: int = 500) -> DataFrame:
    """One row over the newest limit records of a root: records, score, complexity, risks moved from the first to the last (null for fewer than two)."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    own = page(records, root, min(limit, most) or most)
    ends = own.agg(F.count(F.lit(1)).alias("records"), *[F.struct(F.min_by(c, "id").alias("a"), F.max_by(c, "id").alias("b")).alias(c) for c in ("score", "avg_complexity", "risk_count")])
    two = F.col("records") >= 2
    moved = lambda c: F.when(two, round2(F.col(f"{c}.b") - F.col(f"{c}.a")))
    return ends.select("records", moved("score").alias("score"), moved("avg_complexity").alias("complexity"), F.when(two, F.col("risk_count.b") - F.col("risk_count.a")).cast("bigint").alias("risks"))
