"""History that is read once: partial sums of commits already seen, and only new ones are added.

A store is one Parquet table with two kinds of rows, partitioned by root.  A `seen` row
names a commit; a `part` row holds what one author changed in one path on one day: changes,
added, deleted, the last change and a weight that decays towards the end of that day.  An
append leaves out commits the store knows, adds up the rest and writes both kinds in one
job, so the writer's commit makes it whole or leaves it out.  Nothing stored is read again
but the names of the root's commits.

What is asked for is added up from the parts: churn of a window of whole days, and
ownership, where each part's weight moves forward from its day to now.  Parts of the same
day, path and author from several appends simply add up; compacted() merges them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repolytics import storage
from repolytics.functions.dealing import spread
from repolytics.functions.numeric import decay_weight
from repolytics.operators import churn, ownership

LN2 = 0.6931471805599453
HALF_LIFE_DAYS = ownership.HALF_LIFE_DAYS
SCHEMA = "kind string, commit string, day date, path string, author string, changes bigint, counted bigint, added bigint, deleted bigint, weight double, last_at timestamp, root string"


def _day_end(day: Column) -> Column:
    return (day + F.expr("interval 1 day")).cast("timestamp")


def parts(facts: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """day, path, author, changes, counted, added, deleted, weight, last_at of facts (at, path, author, added, deleted).

    counted is how many changes have line counts; binary ones have none.  Keys are nearly
    distinct, so the rows are dealt by them before they are grouped, not after.
    """
    own = spread(facts.withColumn("day", F.to_date("at")), "day", "path", "author")
    known = F.col("added").isNotNull() & F.col("deleted").isNotNull()
    return own.groupBy("day", "path", "author").agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(known).alias("counted"), F.coalesce(F.sum(F.when(known, F.col("added"))), F.lit(0)).cast("bigint").alias("added"), F.coalesce(F.sum(F.when(known, F.col("deleted"))), F.lit(0)).cast("bigint").alias("deleted"),
        F.sum(decay_weight("at", _day_end(F.col("day")), half_life_days)).alias("weight"), F.max("at").alias("last_at"),
    )


class Store:
    """The partial sums of any number of roots in a folder."""

    def __init__(self, spark: SparkSession, folder: str, half_life_days: float = HALF_LIFE_DAYS):
        self._spark, self.folder, self._half_life = spark, folder, half_life_days

    def _rows(self, kind: str, root: str | None = None) -> DataFrame:
        if not storage.exists(self._spark, self.folder):
            return self._spark.createDataFrame([], SCHEMA).filter(F.lit(False))
        found = self._spark.read.schema(SCHEMA).parquet(self.folder).filter(F.col("kind") == kind)
        return found if root is None else found.filter(F.col("root") == root)

    def append(self, facts: DataFrame, root: str) -> None:
        """Add the commits of facts (commit, at, author, path, added, deleted) that the store does not know.

        A commit comes whole in one append; what comes again of a known one is left out.
        """
        fresh = facts.withColumn("commit", F.col("commit").cast("string")).join(self._rows("seen", root).select("commit"), "commit", "left_anti")
        names = fresh.select("commit").distinct().withColumn("kind", F.lit("seen"))
        sums = parts(fresh, self._half_life).withColumn("kind", F.lit("part"))
        both = names.unionByName(sums, allowMissingColumns=True).withColumn("root", F.lit(root))
        both.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("append").partitionBy("root").parquet(self.folder)

    def churn(self, root: str, now, window_days: int | None = None) -> DataFrame:
        """path, commits, added, deleted, score as operators.churn has them, of the last window_days whole days and today."""
        own = self._rows("part", root).filter("counted > 0")
        if window_days is not None:
            own = own.filter(F.col("day") >= F.date_sub(F.to_date(F.lit(now).cast("timestamp")), window_days))
        sums = own.groupBy("path").agg(F.sum("counted").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
        return sums.withColumn("score", F.col("commits") + F.col("added") + F.col("deleted"))

    def concentration(self, root: str, now, window_days: int | None = None) -> DataFrame:
        return churn.concentration(self.churn(root, now, window_days))

    def owners(self, root: str, now) -> DataFrame:
        """Ownership by path as operators.ownership has it.

        A day's weight moves forward to now; changes after now, which count fully, are not
        told apart within a day, so now should not lie before the last change.
        """
        days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(_day_end(F.col("day")))) / F.lit(86400e6)
        weight = F.col("weight") * F.exp(days * (-LN2 / self._half_life))  # today ends after now: there it moves back
        each = self._rows("part", root).groupBy(F.col("path").alias("unit"), "author").agg(F.sum("changes").alias("commits"), F.sum(weight).alias("weight"), F.max("last_at").alias("last_commit"))
        return ownership._ranked(each, ["unit"], [])

    def commits(self, root: str) -> int:
        return self._rows("seen", root).count()

    def compacted(self, root: str) -> None:
        """Merge a root's parts of the same day, path and author, so that many small appends do not slow it down."""
        kept = self._rows("part", root).groupBy("kind", "day", "path", "author", "root").agg(
            *(F.sum(c).alias(c) for c in ("changes", "counted", "added", "deleted", "weight")), F.max("last_at").alias("last_at")
        )
        both = self._rows("seen", root).select("kind", "commit", "root").unionByName(kept, allowMissingColumns=True)
        beside = storage.new_folder(self._spark, "compacted")
        both.write.parquet(beside)
        again = self._spark.read.parquet(beside)
        again.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root").parquet(self.folder)
        storage.remove(self._spark, beside)
