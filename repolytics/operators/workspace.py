"""Workspaces: packages of a repository, and what belongs to each of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from repolytics.functions.predicates import ancestors, dir_of, matches_glob
from repolytics.functions.numeric import round2
from repolytics.functions.text import PRUNED_DIRS, looks_like_path
from repolytics.operators.code import code_stats
from repolytics.sources import workspaces as marks

MOST_PACKAGES = 200
MOST_DEPTH = 8


def resolve(dirs: DataFrame, manifests: DataFrame, include: list[str], exclude: list[str] = [], limit: int = 200) -> DataFrame:
    """dir of the directories (dir) that the globs include, do not exclude and that hold a manifest (dir)."""
    any_of = lambda globs: reduce(lambda a, b: a | b, [matches_glob("dir", g) for g in globs], F.lit(False))
    kept = dirs.select("dir").distinct().filter(any_of(include) & ~any_of(exclude))
    return kept.join(manifests.select("dir").distinct(), "dir", "left_semi").orderBy("dir").limit(limit)


def detect(files: DataFrame) -> DataFrame:
    """root, kind, marker, package, manifest, name, ecosystem of the workspace of each root.

    files: root, path, text (text of markers and manifests; of others it may be null).
    The first marker, in order, that declares packages which exist decides: folders that
    an included glob names, no excluded one does, that hold a manifest and lie at most
    MOST_DEPTH deep outside hidden and build folders.  At most MOST_PACKAGES a root, in
    the order of their paths.
    """
    found = marks.markers(files)
    names = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*map(F.lit, marks.MANIFESTS)), names)
    held = files.filter(names.isin(*marks.MANIFESTS) & F.col("path").contains("/"))
    held = held.select("root", dir_of("path").alias("package"), F.struct(rank.alias("rank"), names.alias("manifest"), "text").alias("m"))
    folders = held.groupBy("root", "package").agg(F.min("m").alias("m")).filter(F.size(F.split("package", "/")) <= MOST_DEPTH)
    parts = F.split("package", "/")
    folders = folders.filter(~F.exists(parts, lambda p: p.isin(*PRUNED_DIRS["packages"]) | p.startswith(".")))
    wanted = found.select("root", "marker", "exclude", F.explode("include").alias("glob"))
    matched = folders.join(wanted, "root").filter(F.regexp("package", marks.glob_regex("glob")))
    left_out = F.exists("exclude", lambda g: F.regexp("package", marks.glob_regex(g, absorbing=True)))
    kept = matched.filter(~left_out).select("root", "marker", "package", "m").distinct()
    first = kept.groupBy("root").agg(F.min(F.struct(marks.priority("marker").alias("at"), "marker")).alias("first"))
    chosen = kept.join(first.select("root", F.col("first.marker").alias("marker")), ["root", "marker"])
    ranked = chosen.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("package"))).filter(F.col("n") <= MOST_PACKAGES)
    name = F.when(F.col("m.manifest") == "package.json", F.coalesce(F.trim(F.get_json_object("m.text", "$.name")), F.lit(""))).otherwise("")
    ecosystem = F.try_element_at(F.create_map(*[F.lit(x) for pair in marks.MANIFESTS.items() for x in pair]), F.col("m.manifest"))
    return ranked.select("root", marks.kind("marker").alias("kind"), "marker", "package", F.concat("package", F.lit("/"), "m.manifest").alias("manifest"), name.alias("name"), ecosystem.alias("ecosystem"))


def attribute_risks(risks: DataFrame, packages: DataFrame) -> DataFrame:
    """package, risks (sorted ids) of the packages (path) that hold a risk's subject.

    risks: id, subject.  A subject that is no file's path belongs to no package; of nested
    packages the first in path order has it.
    """
    placed = attribute(risks.filter(looks_like_path("subject")).select("id", "subject").distinct(), packages, "subject", "id")
    return placed.filter("package is not null").groupBy("package").agg(F.array_sort(F.collect_set("id")).alias("risks"))


def health_of(records: DataFrame, packages: DataFrame, churn: DataFrame, ecosystems: DataFrame) -> DataFrame:
    """package, code statistics, hotspots, dependency figures, score and grade of each package.

    Code and dependencies count; history describes the repository, not a folder, and does
    not.  packages: path.  ecosystems: package, direct, drift.  A package without a
    manifest of dependencies is scored on the neutral value of one.
    """
    from repolytics.operators.code import hotspots
    from repolytics.plans import health

    own = members(records, packages)
    stats = code_stats(own, by="package")
    hot = members(hotspots(records, churn, limit=None), packages)
    first = Window.partitionBy("package").orderBy(F.desc("confirmed"), F.desc("code_lines"), "path")
    hot = hot.withColumn("n", F.row_number().over(first)).filter("n <= 10").groupBy("package").agg(F.count(F.lit(1)).alias("hotspots"), F.sum("code_lines").alias("hotspot_lines"))
    deps = ecosystems.groupBy("package").agg(F.sum("direct").cast("bigint").alias("direct"), (~F.bool_or("drift")).alias("locked"), F.count(F.lit(1)).alias("ecosystems"))
    both = stats.join(hot, "package", "left").join(deps, "package", "left").na.fill({"hotspots": 0, "hotspot_lines": 0, "direct": 0, "ecosystems": 0}).withColumn("locked", F.coalesce("locked", F.lit(True)))
    scored = both.withColumns({
        "code_score": F.when(F.col("files") > 0, health.code_score("avg_file_lines", "hotspot_lines", "code_lines", "files", F.least("languages", F.lit(8)))),
        "dependency_score": health.dependency_score("direct", F.col("locked"), "ecosystems"), "git_score": F.lit(None).cast("double"),
    })
    total = health.total(health.metrics(scored, ["package"]), ["package"])
    return scored.drop("git_score").join(total, "package")


def risks_of(measured: DataFrame) -> DataFrame:
    """package, key, severity, impact: what each package (of health_of) falls short in, highest impact first.

    A package's risks are the measures that lack ten points or more, weighed; they have no
    subject and do not come from the rules of the whole repository.
    """
    from repolytics.plans import health

    own = measured.select("package", "code_score", "dependency_score", F.lit(None).cast("double").alias("git_score"))
    each = health.metrics(own, ["package"])
    short = health.metric_risks(each, ["package"]).join(each.select("package", "key", "weight"), ["package", "key"])
    return short.select("package", "key", "severity", round2(F.col("deficit") * F.col("weight")).alias("impact")).orderBy("package", F.desc("impact"), "key")


def attribute(items: DataFrame, packages: DataFrame, subject: str, item: str) -> DataFrame:
    """items with package: the first package (in path order) that is or holds the subject.

    Each subject is exploded into its ancestors, so the prefix join is an equi-join.
    """
    held = items.select(item, F.explode(ancestors(subject)).alias("path_prefix")).join(packages.select(F.col("path").alias("path_prefix")), "path_prefix")
    first = held.groupBy(item).agg(F.min("path_prefix").alias("package"))
    return items.join(first, item, "left")


def members(files: DataFrame, packages: DataFrame) -> DataFrame:
    """files with package for every package that holds them (nested packages: several rows)."""
    return files.withColumn("package", F.explode(ancestors("path"))).join(packages.select(F.col("path").alias("package")), "package")


def rollup(records: DataFrame, packages: DataFrame) -> DataFrame:
    """Code statistics of each package."""
    return code_stats(members(records, packages), by="package")


def nearest(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, package: the deepest known package above each file."""
    held = members(files.select("path"), packages)
    deepest = Window.partitionBy("path").orderBy(F.desc(F.length("package")))
    return held.withColumn("n", F.row_number().over(deepest)).filter("n = 1").select("path", "package")


def package_of(paths: DataFrame, packages: DataFrame, module: str) -> DataFrame:
    """path, package: the deepest known package (module in front) whose folder holds each path.

    Paths at the root are in the module's own package; null where no package holds a path
    or there is no module.
    """
    if not module:
        return paths.select("path", F.lit(None).cast("string").alias("package"))
    inner = packages.filter(F.col("package").startswith(f"{module}/")).select(F.substring("package", len(module) + 2, 1 << 20).alias("path"))
    deepest = nearest(paths, inner).select(F.col("path").alias("held"), F.col("package").alias("folder"))
    named = paths.select("path").join(deepest, F.col("path") == F.col("held"), "left")
    return named.select("path", F.when(F.instr("path", "/") == 0, F.lit(module)).when(F.col("folder").isNotNull(), F.concat(F.lit(f"{module}/"), "folder")).alias("package"))
