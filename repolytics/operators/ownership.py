"""Who knows what: recency-weighted ownership, bus factor and quiet owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from repolytics.functions.dealing import spread
from repolytics.functions.numeric import age_days, decay_weight, ratio, round_half
from repolytics.functions.predicates import folder_of

HALF_LIFE_DAYS = 90.0
RISK_SHARE = 0.7
QUIET_DAYS = 90
LEAST_HISTORY_DAYS = 30


def owners(facts: DataFrame, unit, now, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """unit, author, commits, weighted_share, share, last_commit, rank, running_share.

    unit is the column (or expression) that ownership is grouped by.  Shares are rounded
    to four decimals, their running sum is not; rank is total: weighted share, commits,
    then name.
    """
    each = facts.groupBy(F.col(unit).alias("unit") if isinstance(unit, str) else unit.alias("unit"), "author").agg(
        F.count(F.lit(1)).alias("commits"), F.sum(decay_weight("at", F.lit(now), half_life_days)).alias("weight"), F.max("at").alias("last_commit")
    )
    return _ranked(each, ["unit"], [])


def units(facts: DataFrame, now, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """scope, unit, author, commits, weighted_share, share, last_commit, rank, running_share, files.

    Ownership of every path, of every folder (`.` at the root) and of the repository (scope
    `repository`, unit empty) in one pass: a change counts once for its path and folder, a
    commit once for the repository.  The rows are brought together by commit, then expanded
    into the grouping sets and added up before they are shuffled.  files is how many paths a
    folder holds, 1 of a path, null of the repository.
    """
    inside = Window.partitionBy("commit").orderBy("path")
    each = spread(facts.select("commit", "path", "author", "at"), "commit").groupBy("commit", "path").agg(F.min("author").alias("author"), F.min("at").alias("at"))
    weighed = each.select(
        "path", folder_of("path").alias("folder"), "author", "at", decay_weight("at", F.lit(now), half_life_days).alias("w"), (F.row_number().over(inside) == 1).cast("int").alias("first")
    )
    one, w = F.lit(1), F.col("w")
    sets = weighed.groupingSets([["path", "author"], ["folder", "author"], ["author"], ["folder", "path"]], "path", "folder", "author").agg(
        F.grouping("path").alias("no_path"), F.grouping("folder").alias("no_folder"), F.grouping("author").alias("no_author"),
        F.count(one).alias("changes"), F.sum("first").alias("commits"), F.sum(w).alias("weight"), F.sum(w * F.col("first")).alias("commit_weight"), F.max("at").alias("last_commit"),
    )
    scope = F.when(F.col("no_author") == 1, "folder").when(F.col("no_path") == 0, "path").when(F.col("no_folder") == 0, "folder").otherwise("repository")
    whole = F.col("scope") == "repository"
    named = sets.withColumn("scope", scope).select(
        "scope", F.when(F.col("scope") == "path", F.col("path")).when(F.col("scope") == "folder", F.col("folder")).otherwise("").alias("unit"), "author", (F.col("no_author") == 1).alias("held"),
        F.when(whole, F.col("commits")).otherwise(F.col("changes")).alias("commits"), F.when(whole, F.col("commit_weight")).otherwise(F.col("weight")).alias("weight"), "last_commit",
    )
    unit = Window.partitionBy("scope", "unit")
    files = F.when(F.col("scope") == "folder", F.sum(F.col("held").cast("bigint")).over(unit)).when(F.col("scope") == "path", F.lit(1))
    counted = named.withColumn("files", files.cast("bigint")).filter("not held")
    return _ranked(counted, ["scope", "unit"], ["files"])


def _ranked(each: DataFrame, by: list[str], more: list[str]) -> DataFrame:
    """Shares, rank and running share of rows of author, commits, weight, last_commit."""
    whole = Window.partitionBy(*by)
    shared = each.select(
        *by, "author", "commits", "last_commit", *more,
        round_half(ratio(F.col("weight"), F.sum("weight").over(whole)), 4).alias("weighted_share"),
        round_half(ratio(F.col("commits"), F.sum("commits").over(whole)), 4).alias("share"),
    )
    order = whole.orderBy(F.desc("weighted_share"), F.desc("commits"), "author")
    running = F.sum("weighted_share").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return shared.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("running_share", running)


def directories(facts: DataFrame, folder, now, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """unit, files, owner, weighted_share of every folder: its distinct files and its dominant author."""
    unit = F.col(folder) if isinstance(folder, str) else folder
    files = facts.groupBy(unit.alias("unit")).agg(F.countDistinct("path").alias("files"))
    first = owners(facts, unit, now, half_life_days).filter("rank = 1").select("unit", F.col("author").alias("owner"), "weighted_share")
    return files.join(first, "unit")


def bus_factor(owned: DataFrame, threshold: float = RISK_SHARE) -> DataFrame:
    """unit, authors, bus_factor: the fewest owners whose shares reach the threshold."""
    reached = F.min(F.when(F.col("running_share") >= threshold, F.col("rank")))
    return owned.groupBy("unit").agg(F.count(F.lit(1)).alias("authors"), F.coalesce(reached, F.count(F.lit(1))).alias("bus_factor"))


def risk(owned: DataFrame, now, history_days: int | None = None, risk_share: float = RISK_SHARE, quiet_days: int = QUIET_DAYS, least_history: int = LEAST_HISTORY_DAYS) -> DataFrame:
    """unit, owner, weighted_share, inactive_days, at_risk of the dominant author.

    at_risk is null (withheld) where the history is too short to judge.
    """
    quiet = age_days("last_commit", F.lit(now))
    judged = (F.col("weighted_share") >= risk_share) & (quiet >= quiet_days)
    known = F.lit(history_days is None or history_days >= least_history)
    return owned.filter(F.col("rank") == 1).select("unit", F.col("author").alias("owner"), "weighted_share", quiet.alias("inactive_days"), F.when(known, judged).alias("at_risk"))
