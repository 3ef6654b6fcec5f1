"""What fades: paths nobody touches, paths one author holds, the half-life of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from repolytics.functions.numeric import age_days, elapsed_seconds, ratio, round2
from repolytics.operators.evidence import LEAST_HALF_LIFE_DAYS, enough_for_half_life, with_gate


def orphans(facts: DataFrame, now, window_days: int = 90, limit: int | None = None) -> DataFrame:
    """path, last_commit, age_days, commits of paths without a commit after the window's start.

    With a limit the oldest first, then by name.
    """
    last = facts.groupBy("path").agg(F.max("at").alias("last_commit"), F.countDistinct("commit").alias("commits"))
    start = F.lit(now).cast("timestamp") - F.expr(f"interval {window_days} days")
    found = last.filter(F.col("last_commit") <= start).select("path", "last_commit", age_days("last_commit", F.lit(now)).alias("age_days"), "commits")
    return found if limit is None else found.orderBy(F.desc("age_days"), "path").limit(limit)


def silos(facts: DataFrame, share: float = 0.9, least_commits: int = 3, limit: int | None = None) -> DataFrame:
    """path, author, commits, share of paths that one author nearly owns (ties: the smaller name).

    Changes without an author count for the path and for nobody.  With a limit the highest
    share first, then most commits, then by name.
    """
    each = facts.groupBy("path", F.nullif("author", F.lit("")).alias("author")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("path")
    totals = each.withColumn("commits", F.sum("n").over(whole).cast("bigint")).filter("author is not null")
    ranked = totals.withColumn("r", F.row_number().over(whole.orderBy(F.desc("n"), "author")))
    exact = ratio("n", "commits")
    first = ranked.filter((F.col("r") == 1) & (F.col("commits") >= least_commits) & (exact >= share))
    if limit is not None:
        first = first.orderBy(F.desc(exact), F.desc("commits"), "path").limit(limit)
    return first.select("path", "author", "commits", round2(exact).alias("share"))


def half_life(commits: DataFrame, now, least_history_days: int = LEAST_HALF_LIFE_DAYS) -> DataFrame:
    """One row: history_days, prior_rate, recent_rate, half_life_days, reason.

    The history from the first to the last commit is cut in half; the ratio of commits in
    both halves gives the days in which activity halves: 0 where it does not fall (or had
    not begun), -1 where it stopped.  Whether the history is long enough is judged from its
    first commit to now; where it is not, the figures are null and the reason says why.
    Commits at one moment alone have no rates.  commits: commit, at.
    """
    own = commits.select("commit", F.col("at").cast("timestamp").alias("at"))
    ends = own.agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_distinct("commit").alias("commits"))
    middle = F.timestamp_micros(F.unix_micros("first_at") + F.floor((F.unix_micros("last_at") - F.unix_micros("first_at")) / 2))
    marked = own.crossJoin(F.broadcast(ends.select(middle.alias("middle"))))
    halves = marked.agg(F.count_if(F.col("at") < F.col("middle")).alias("prior"), F.count_if(F.col("at") >= F.col("middle")).alias("recent"))
    one = ends.crossJoin(F.broadcast(halves)).withColumn("history_days", F.coalesce(age_days("first_at", F.lit(now)), F.lit(0).cast("bigint")))
    days = elapsed_seconds("first_at", "last_at") / 86400
    r = F.try_divide(F.col("recent").cast("double"), F.col("prior").cast("double"))
    value = F.when(F.col("prior") <= 0, 0.0).when(r <= 0, -1.0).when(r >= 1, 0.0).otherwise(round2(F.ln(F.lit(0.5)) / F.ln(r) * (days / 2)))
    rate = lambda n: F.when(days > 0, round2(ratio(F.col(n), days / 2)))
    figures = one.select("commits", "history_days", rate("prior").alias("prior_rate"), rate("recent").alias("recent_rate"), F.when(days > 0, value).alias("half_life_days"))
    ok, why = enough_for_half_life(least_history_days)
    return with_gate(figures, ok, why, "prior_rate", "recent_rate", "half_life_days").drop("commits")
