"""Co-change: pairs of paths that change together, hidden coupling, impact expansion.

A pair (a < b) of a commit is one row, so a commit of n paths makes n(n-1)/2 rows by
definition.  Commits are made distinct by path first, paths too rare for any pair go
before the join, and max_paths (off by default) leaves out sweeping commits.  The paths of
a large commit are dealt to blocks, and each pair of blocks is a join key of its own: a
task then has the pairs of two blocks, whatever the commit's size.  Those keys are dealt
over all shuffle partitions, as pairs are many more than the rows they come from.  Both
sides are the same rows up to there, so that Spark deals them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from repolytics.functions.dealing import spread
from repolytics.functions.numeric import clamp01, ratio

BLOCK_PATHS = 500
LEAST_COMMITS = 10


def touched(facts: DataFrame, max_paths: int | None = None) -> DataFrame:
    """Distinct commit, path, at."""
    each = facts.groupBy("commit", "path").agg(F.min("at").alias("at"))
    if max_paths is None:
        return each
    size = Window.partitionBy("commit")
    return each.withColumn("paths", F.count(F.lit(1)).over(size)).filter(F.col("paths") <= max_paths).drop("paths")


def _blocks(each: DataFrame, block_paths: int) -> DataFrame:
    """each with blocks: over how many blocks the paths of its commit are dealt."""
    n = F.count(F.lit(1)).over(Window.partitionBy("commit"))
    return each.withColumn("blocks", F.ceil(n / F.lit(block_paths)).cast("int"))


def _grid(often: DataFrame, block_paths: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of paths with paths of the same commit, by (commit, low, high).

    low and high are the blocks of a pair.  A path of block k stands once in each cell
    that k is an end of, so any two blocks meet in one cell; a commit of up to block_paths
    paths is one block and one key.  The sides differ in names alone, so the cells are
    dealt once; which paths of a cell make a pair is told after they met.
    """
    sized = often if "blocks" in often.columns else _blocks(often, block_paths)
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread(dealt.select("commit", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "path", "at", "n"), "commit", "low", "high")
    side = lambda x: cells.select("commit", "low", "high", F.col("block").alias(f"block_{x}"), F.col("path").alias(x), F.col("at").alias(f"at_{x}"), F.col("n").alias(f"n_{x}"))
    return side("a"), side("b")


def pairs(facts: DataFrame, min_shared: int = 3, threshold: float = 0.6, max_paths: int | None = None, block_paths: int = BLOCK_PATHS) -> DataFrame:
    """a, b, shared, commits_a, commits_b, coupling, first_shared, last_shared."""
    each = touched(facts, max_paths)
    totals = each.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_shared)
    left, right = _grid(_blocks(each, block_paths).join(totals.hint("shuffle_hash"), "path"), block_paths)  # a rarer path is in no pair
    within = (F.col("low") == F.col("high")) & (F.col("a") < F.col("b"))
    met = left.join(right, ["commit", "low", "high"]).filter((F.col("block_a") < F.col("block_b")) | within)  # conditions on one side would part the sides' shuffles
    turned = F.col("a") > F.col("b")
    both = met.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("at_b")).otherwise(F.col("at_a")).alias("at"), F.when(turned, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(turned, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b")
    )
    counted = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("at").alias("first_shared"), F.max("at").alias("last_shared"), F.min("n_a").alias("commits_a"), F.min("n_b").alias("commits_b"))
    out = counted.filter(F.col("shared") >= min_shared).withColumn("coupling", clamp01(ratio("shared", F.least("commits_a", "commits_b")))).filter(F.col("coupling") >= threshold)
    return out.select("a", "b", "shared", "commits_a", "commits_b", "coupling", "first_shared", "last_shared")


def strongest(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs in their order: coupling, then how often, then by name."""
    ordered = found.orderBy(F.desc("coupling"), F.desc("shared"), "a", "b")
    return ordered if limit is None else ordered.limit(limit)


def related(found: DataFrame, packages: DataFrame, imports: DataFrame) -> DataFrame:
    """Pairs with same_package and imports: whether their packages are one, or one imports the other.

    packages: path, package (null where a path is in none).  imports: src, dst.  Paths of
    one package count as importing each other; without a package neither holds.
    """
    edges = imports.select("src", "dst").union(imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("direct", F.lit(True))
    a, b = (packages.select(F.col("path").alias(x), F.col("package").alias(f"package_{x}")) for x in "ab")
    named = found.join(a, "a", "left").join(b, "b", "left")
    met = named.join(edges, (F.col("package_a") == F.col("src")) & (F.col("package_b") == F.col("dst")), "left")
    same = F.coalesce(F.col("package_a") == F.col("package_b"), F.lit(False))
    return met.select(*found.columns, same.alias("same_package"), (same | F.coalesce("direct", F.lit(False))).alias("imports"))


def hidden(found: DataFrame, packages: DataFrame, imports: DataFrame) -> DataFrame:
    """Pairs without an import in either direction between their packages."""
    return related(found, packages, imports).filter("not imports").select(*found.columns)


def expand(found: DataFrame, changeset: DataFrame, max_hops: int = 3, limit: int = 50) -> DataFrame:
    """path, hops, coupling, via, shared: what a changeset (path) is likely to touch.

    Breadth first over the pair graph: a path is reached in the fewest hops, by the
    strongest last link, ties by the smaller predecessor.  One join a hop; the rows are
    the paths reached so far, never the walks.  Pairs and each hop's paths are cached
    until the few predictions are known.  In order: hops, coupling, shared, then by name.
    """
    found = found.select("a", "b", "coupling", "shared").persist()
    both = found.select(F.col("a").alias("from"), F.col("b").alias("to"), "coupling", "shared").union(found.select(F.col("b").alias("from"), F.col("a").alias("to"), "coupling", "shared"))
    seeds = changeset.select("path").distinct().select("path", F.lit(0).cast("bigint").alias("hops"), F.lit(None).cast("double").alias("coupling"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("bigint").alias("shared"))
    known = frontier = seeds
    held = [found]
    best = Window.partitionBy("to").orderBy(F.desc("coupling"), "from")
    for hop in range(1, max_hops + 1):
        step = frontier.select(F.col("path").alias("from")).join(both, "from")
        new = step.join(known.select(F.col("path").alias("to")), "to", "left_anti").withColumn("n", F.row_number().over(best)).filter("n = 1")
        frontier = new.select(F.col("to").alias("path"), F.lit(hop).cast("bigint").alias("hops"), "coupling", F.col("from").alias("via"), "shared").persist()
        held.append(frontier)
        known = known.unionByName(frontier)
    first = known.filter("hops > 0").orderBy("hops", F.desc("coupling"), F.desc("shared"), "path").limit(limit)
    rows = first.collect()  # limit rows at most
    for frame in held:
        frame.unpersist()
    return found.sparkSession.createDataFrame(rows, first.schema).orderBy("hops", F.desc("coupling"), F.desc("shared"), "path")
