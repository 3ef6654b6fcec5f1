"""Change volume: churn by path, its concentration, authors and cadence.

Facts: a row for each path a commit touches, with commit, at, author, path, added and
deleted (null counts: a binary change).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repolytics.functions.numeric import age_days, clamp01, ratio, round2


def churn_by_path(facts: DataFrame, path: str = "path", added: str = "added", deleted: str = "deleted") -> DataFrame:
    """path, commits, added, deleted, score; rows without counts do not count."""
    known = facts.filter(F.col(added).isNotNull() & F.col(deleted).isNotNull())
    sums = known.groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("commits"), F.sum(added).cast("bigint").alias("added"), F.sum(deleted).cast("bigint").alias("deleted"))
    return sums.withColumn("score", F.col("commits") + F.col("added") + F.col("deleted"))


def top_churn(churn: DataFrame, limit: int = 10) -> DataFrame:
    return churn.orderBy(F.desc("score"), F.desc("added"), "path").limit(limit)


def concentration(churn: DataFrame, score: str = "score") -> DataFrame:
    """One row: the normalised Herfindahl index of scores (0 spread, 1 in one path).

    Sums of scores and of their squares are enough, so it is one pass without a window.
    """
    sums = churn.agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum(score), F.lit(0)).cast("bigint").alias("total"), F.sum(F.col(score).cast("double") * F.col(score)).alias("squares"))
    n, total = F.col("paths").cast("double"), F.col("total").cast("double")
    value = F.when((F.col("paths") == 0) | (F.col("total") == 0), 0.0).when(F.col("paths") == 1, 1.0).otherwise(clamp01(F.when(F.col("paths") > 1, F.try_divide(F.col("squares"), total * total) - 1 / n).otherwise(0.0) / F.when(n > 1, 1 - 1 / n).otherwise(1.0)))
    return sums.select("paths", "total", round2(value).alias("concentration"))


def hotspot_rate(churn: DataFrame, top: int = 3) -> DataFrame:
    """One row: score of the most changed paths over all changed lines (may pass 1)."""
    first = top_churn(churn, top).agg(F.coalesce(F.sum("score"), F.lit(0)).alias("top_score"))
    total = churn.agg(F.coalesce(F.sum(F.col("added") + F.col("deleted")), F.lit(0)).alias("changed"))
    return first.crossJoin(total).select(F.col("top_score").cast("bigint").alias("top_score"), F.col("changed").cast("bigint").alias("changed"), round2(ratio("top_score", "changed")).alias("rate"))


def author_counts(commits: DataFrame, author: str = "author") -> DataFrame:
    return commits.groupBy(F.col(author).alias("author")).agg(F.count(F.lit(1)).alias("commits"))


def top_share(counts: DataFrame) -> DataFrame:
    """One row: the share of the author with most commits."""
    return counts.agg(F.max("commits").alias("most"), F.sum("commits").cast("bigint").alias("commits")).select("most", "commits", round2(ratio("most", "commits")).alias("top_share"))


def bus_factor(counts: DataFrame, threshold: float = 0.20) -> DataFrame:
    """One row: how many authors hold at least the threshold share of commits."""
    total = counts.agg(F.sum("commits").cast("bigint").alias("total"))
    return counts.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum((ratio("commits", "total") >= threshold).cast("bigint")), F.lit(0)).cast("bigint").alias("bus_factor"))


def cadence(commits: DataFrame, now, window_days: int = 90, at: str = "at") -> DataFrame:
    """One row: commits in the window, the span they cover, commits a week, idle days."""
    sums = commits.agg(
        F.count(F.lit(1)).alias("commits"), F.min(at).alias("first"), F.max(at).alias("last"),
        F.coalesce(F.sum((F.col(at) >= F.lit(now).cast("timestamp") - F.expr(f"interval {window_days} days")).cast("bigint")), F.lit(0)).alias("window_commits"),
    )
    span = F.least(F.lit(window_days).cast("bigint"), age_days("first", F.lit(now)) + 1)
    return sums.select(
        "commits", "window_commits", span.alias("span_days"),
        round2(ratio(F.col("window_commits") * 7, span)).alias("commits_per_week"),
        age_days("last", F.lit(now)).alias("days_since_commit"),
    )

