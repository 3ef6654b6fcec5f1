"""The health score: three weighted measures over code, dependencies and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repolytics.functions.numeric import clamp01, col, ratio, round2
from repolytics.functions.predicates import grade, trend_status

WEIGHTS = {"code": 0.40, "dependency": 0.30, "git": 0.30}


def size_score(avg_lines) -> Column:
    """Full marks for files of 25 to 150 lines, less on either side."""
    avg = col(avg_lines)
    above, below = (avg - 150) / F.lit(150.0), (25 - avg) / F.lit(15.0)
    return F.when(avg > 150, 100 * (1 - clamp01(above))).when(avg < 25, 100 * (1 - clamp01(below))).otherwise(100.0)


def code_score(avg_lines, hotspot_lines, code_lines, files, languages) -> Column:
    """Half size, three tenths the share of lines in hotspots, two tenths files for each language."""
    hot = 100 * (1 - clamp01(ratio(hotspot_lines, code_lines) / 0.30))
    each = ratio(files, languages)
    cohesion = F.when(col(languages) == 0, 100.0).when(each < 1, 0.0).otherwise(100 * F.least(F.lit(1.0), each / 40))
    return round2(0.5 * size_score(avg_lines) + 0.3 * hot + 0.2 * cohesion)


def dependency_score(direct, locked, ecosystems) -> Column:
    """Half the number of direct dependencies, three tenths locks, two tenths spread."""
    count = 100 * (1 - clamp01(ratio(direct, 50)))
    spread = F.when(col(ecosystems) <= 1, 100.0).otherwise(ratio(100, ecosystems))
    score = round2(0.5 * count + 0.3 * F.when(col(locked), 100.0).otherwise(80.0) + 0.2 * spread)
    return F.when(col(ecosystems) == 0, 90.0).otherwise(score)


def git_score(commits, per_week, span_days, idle_days, concentration, bus_factor) -> Column:
    """Cadence, freshness, churn spread and bus factor; cadence waits for 28 days of span."""
    pace = col(per_week)
    cadence = F.when(pace >= 8, 100.0).when(pace <= 0.5, 0.0).otherwise((pace - 0.5) / 7.5 * 100)
    fresh = 100 * (1 - clamp01(col(idle_days) / F.lit(180.0)))
    spread = 100 * (1 - clamp01(col(concentration) / 0.6))
    shared = F.when(col(bus_factor) <= 1, 85.0).otherwise(100.0)
    weight = F.when(col(span_days) < 28, 0.0).otherwise(0.30)
    total = cadence * weight + fresh * 0.25 + spread * 0.25 + shared * 0.20
    return F.when(col(commits) == 0, 0.0).otherwise(round2(total / (weight + 0.70)))


def metrics(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys, key, score, weight, applicable from columns code_score, dependency_score, git_score.

    A null score is a measure that does not apply.
    """
    parts = ", ".join(f"'{k}', {k}_score, {w}D" for k, w in WEIGHTS.items())
    return frame.selectExpr(*keys, f"stack({len(WEIGHTS)}, {parts}) as (key, score, weight)").withColumn("applicable", F.col("score").isNotNull())


def total(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, grade, weakest, label; weights are renormalised over what applies."""
    some = measured.filter("applicable")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), "key", "score", "weight")))  # at most three
    add = lambda value: F.aggregate("parts", F.lit(0.0), lambda total, p: total + value(p))  # noqa: E731  in one order, so that halves round alike
    sums = some.groupBy(*keys).agg(parts.alias("parts"), F.min_by("key", F.struct("score", -F.col("weight"), "key")).alias("weakest"))
    sums = sums.withColumn("raw", ratio(add(lambda p: p["score"] * p["weight"]), add(lambda p: p["weight"])))
    label = F.when(F.col("raw") >= 85, "excellent").when(F.col("raw") >= 70, "good").when(F.col("raw") >= 55, "fair").when(F.col("raw") >= 40, "weak").otherwise("poor")
    return sums.select(*keys, round2("raw").alias("score"), grade("raw").alias("grade"), "weakest", label.alias("label"))


def metric_risks(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, key, severity, deficit of measures that lack ten points or more."""
    short = measured.filter(F.col("applicable") & (100 - F.col("score") >= 10)).withColumn("deficit", round2(100 - F.col("score")))
    severity = F.when(F.col("deficit") >= 60, "critical").when(F.col("deficit") >= 40, "high").otherwise("medium")
    return short.select(*keys, "key", severity.alias("severity"), "deficit")


def categories(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position, label, value, before, unit, delta, status: the rows of a build's report.

    frame: code_score, dependency_score, git_score (null: does not apply),
    test_file_ratio, and the same with previous_ of the baseline (null: none).  The build
    itself is never measured and says so.
    """
    rows = [("Code", "code_score", "", 1), ("Dependencies", "dependency_score", "", 1), ("Testing", "test_file_ratio", "%", 100), ("Maintainability", "git_score", "", 1)]
    made = [F.struct(F.lit(at).alias("position"), F.lit(label).alias("label"), (F.col(name) * scale).cast("double").alias("value"), (F.col(f"previous_{name}") * scale).cast("double").alias("before"), F.lit(unit).alias("unit")) for at, (label, name, unit, scale) in enumerate(rows, 1)]
    none = F.lit(None).cast("double")
    made.append(F.struct(F.lit(5).alias("position"), F.lit("Build").alias("label"), none.alias("value"), none.alias("before"), F.lit("").alias("unit")))
    flat = frame.select(*keys, F.explode(F.array(*made)).alias("r")).select(*keys, "r.*").withColumn("delta", F.col("value") - F.col("before"))
    status = F.when(F.col("value").isNull(), "Not measured").when(F.col("before").isNull(), "No baseline").otherwise(trend_status("delta"))
    return flat.withColumn("status", status)
