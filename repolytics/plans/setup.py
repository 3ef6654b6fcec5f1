"""Settings proposed for a repository from what was measured of it, as rows and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repolytics.functions.numeric import age_days

#: Folders always left out, and folders left out where they are there.
ALWAYS_IGNORED = (".git", "node_modules", "vendor")
IGNORED_IF_THERE = ("dist", "build", "out", "target", ".next", ".nuxt", "__pycache__", ".venv", "venv", ".terraform", ".gradle", "coverage")


def window_days(first_commit, now):
    """The history window that suits a repository of this age; 90 days where it is unknown."""
    age = age_days(first_commit, now)
    return F.when(F.col(first_commit).isNull(), 90).when(age < 30, 7).when(age < 90, 30).when(age < 365, 90).otherwise(180).cast("bigint")


def timeout_seconds(took_ms):
    """Four times what the scan took, rounded up to tens, at least 60; null where it was not timed."""
    took = F.col(took_ms)
    return F.when(took > 0, F.greatest(F.lit(60).cast("bigint"), (F.floor((took * 4 + 9999) / 10000) * 10).cast("bigint")))


def propose(snapshots: DataFrame, folders: DataFrame, now) -> DataFrame:
    """root, key, value: what to set for each snapshot.

    snapshots: root, first_commit, took_ms, packages (of its workspace).  folders: root,
    name of the folders at the root.
    """
    there = folders.filter(F.col("name").isin(*IGNORED_IF_THERE)).groupBy("root").agg(F.collect_set("name").alias("there"))
    own = snapshots.join(there, "root", "left")
    ignored = F.array_join(F.array_sort(F.array_distinct(F.concat(F.array(*map(F.lit, ALWAYS_IGNORED)), F.coalesce("there", F.array().cast("array<string>"))))), ",")
    entries = F.array(
        F.struct(F.lit("ignore_dirs").alias("key"), ignored.alias("value")),
        F.struct(F.lit("git_window_days").alias("key"), window_days("first_commit", F.lit(now)).cast("string").alias("value")),
        F.when(F.col("took_ms") > 0, F.struct(F.lit("timeout_seconds").alias("key"), timeout_seconds("took_ms").cast("string").alias("value"))),
        F.when(F.col("packages") > 0, F.struct(F.lit("detect_workspace").alias("key"), F.lit("true").alias("value"))),
    )
    return own.select("root", F.explode(F.array_compact(entries)).alias("e")).select("root", "e.*")


def rendered(proposal: DataFrame) -> str:
    """The proposal of one root as YAML."""
    lines = []
    for row in proposal.orderBy("key").limit(100).collect():
        lines += [f"{row['key']}:", *(f"  - {x}" for x in row["value"].split(","))] if row["key"] == "ignore_dirs" else [f"{row['key']}: {row['value']}"]
    return "\n".join(lines) + "\n"
