"""Evidence gates: figures that are withheld, with a reason, where the data cannot carry them.

A gate is a condition over what is known of the history.  Where it fails the figures are
null (or the rows are left out) and the reason says what there is and what it takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repolytics.functions.numeric import age_days

LEAST_COMMITS = 10
LEAST_OWNERSHIP_DAYS = 30
LEAST_HALF_LIFE_DAYS = 180


def history(commits: DataFrame, now) -> DataFrame:
    """One row: commits, first_at, history_days (whole days from the first commit to now)."""
    sums = commits.agg(F.count_distinct("commit").alias("commits"), F.min("at").alias("first_at"))
    return sums.withColumn("history_days", F.coalesce(age_days("first_at", F.lit(now)), F.lit(0).cast("bigint")))


def reason(condition: Column, text: str, *values) -> Column:
    """Null where the condition holds, else the text with the values in it."""
    return F.when(~condition, F.format_string(text, *values))


def with_gate(frame: DataFrame, condition: Column, why: Column, *withheld: str) -> DataFrame:
    """frame with its withheld columns null and a reason where the condition fails."""
    held = {c: F.when(condition, F.col(c)) for c in withheld}
    return frame.withColumns({**held, "reason": F.when(~condition, why)})


def enough_commits(least: int = LEAST_COMMITS) -> tuple[Column, Column]:
    """Whether co-change ratios mean anything, over a row of history()."""
    ok = F.col("commits") >= least
    return ok, reason(ok, "%d of %d commits: a ratio of so few is no relationship", F.col("commits"), F.lit(least))


def enough_ownership(least: int = LEAST_OWNERSHIP_DAYS) -> tuple[Column, Column]:
    """Whether an owner's absence means anything; an empty history withholds nothing."""
    ok = (F.col("commits") == 0) | (F.col("history_days") >= least)
    return ok, reason(ok, "history of %d of %d days: every author is recent", F.col("history_days"), F.lit(least))


def enough_for_half_life(least: int = LEAST_HALF_LIFE_DAYS) -> tuple[Column, Column]:
    ok = F.col("history_days") >= least
    return ok, F.when(F.col("commits") == 0, F.lit("no commits")).otherwise(reason(ok, "history of %d of %d days", F.col("history_days"), F.lit(least)))


def gates(known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, gate, passed, reason of rows of history(), one a repository."""
    every = {"coupling": enough_commits(), "ownership": enough_ownership(), "half_life": enough_for_half_life()}
    rows = F.array(*(F.struct(F.lit(name).alias("gate"), ok.alias("passed"), why.alias("reason")) for name, (ok, why) in every.items()))
    return known.select(*(keys or []), F.explode(rows).alias("g")).select(*(keys or []), "g.*")
